from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tallycast.llm import near_copies


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least id of each component of texts of similarity 0.8 or more."""
    root, found = {i: i for i, _ in rows}, [(i, grams(t)) for i, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(found):
        for j, y in found[:k]:
            if x == y or x and y and len(x & y) >= 0.8 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("block", [1 << 18, 1500])
def test_near_copies_of_every_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(7)
    texts = []
    for size in (60, 200, 1000):
        for k in range(40):
            words = [f"w{rng.randrange(3000)}" for _ in range(size)]
            texts += [words, changed(rng, words, 1 + k * size // 40 // 20)]
    hot = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts += [changed(rng, hot, rng.randrange(8)) for _ in range(150)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None), (902, "One two"), (903, "one  TWO"), (904, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_bands_meet_at_the_least_similarity():
    rng = np.random.default_rng(3)
    for n in (9, 90, 900):
        for _ in range(100):
            common, own = rng.integers(0, 1 << 63, 8 * n // 9, dtype=np.uint64), rng.integers(0, 1 << 63, 2 * (n // 9), dtype=np.uint64)
            a, b = np.concatenate((common, own[: n // 9])), np.concatenate((common, own[n // 9:]))
            assert (near_copies.bands(a) == near_copies.bands(b)).any()
