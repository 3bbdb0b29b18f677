from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallycast.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def brute_words(rows, every):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % every == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, every):
    words, out = brute_words(rows, every), {}
    for w, n in words.items():
        close = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        form = close[0][1] if close and -close[0][0] >= 10 * n else None
        out[w] = [form, n, len(close), words[form] if form else None]
    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return sorted((w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items())


def answer(spark, rows, every):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, spelling.group_variants(df, every).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def made_up(seed, n_docs):
    rng = random.Random(seed)
    letters = "abcdefghéàÿÉÀ"
    base = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(12)]
    def word():
        w = list(base[min(int(rng.expovariate(0.6)), 11)])
        while rng.random() < 0.25:
            i = rng.randrange(len(w))
            w[i:i + rng.choice([0, 1])] = rng.choices(letters, k=rng.choice([0, 1, 1]))
        return "".join(w).upper() if rng.random() < 0.1 else "".join(w)
    return [(i, " ".join(word() for _ in range(rng.randint(0, 200))) + rng.choice(["", "!", " 12 short"]), "x", 1) for i in range(n_docs)]


def test_equals_brute_force(spark):
    rows = made_up(1, 60)
    for every in (31, 3):
        want = brute(rows, every)
        assert answer(spark, rows, every) == want
    assert any(f and r != f for _, f, r, *_ in want) and any(f for _, f, *_ in want)


def test_edges(spark):
    assert answer(spark, [], 31) == []
    long = "abcdefg" * 20_000
    rows = [(None, f"{long} {long}", None, None), (1, None, "a", 2), (2, "", "a", 2), (3, "sixsix 1234567 ×÷×÷×÷×", "a", 2),
            (4, f"{long[:-1]}x wordings wordings", "a", 2), (4, f"{long[:-1]}x wordings wordings", "a", 2), (2**60, "wordingz Wordingz ßßßßßßß ßßßßßßß", "b", 3)]
    assert answer(spark, rows, 31) == brute(rows, 31)


def test_words_of_one_shape_split_into_parts(spark, monkeypatch):
    """Permutations share all counts, so one block holds them all; parts of four words still meet each other."""
    monkeypatch.setattr(spelling, "BLOCK", 4)
    rng = random.Random(5)
    words = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(60)} | {"abcdefgh", "abcdefgx", "abcdefg", "abcdefghh"})
    rows = [(i, f"{w} {w}", "", 0) for i, w in enumerate(words)]
    assert answer(spark, rows, 10**9) == brute(rows, 10**9)


def test_wide_counts_use_exact_numbers():
    a, b = "a" * 5000 + "b", "a" * 5000 + "c"
    i, j = spelling.near_pairs([a], [b], False)
    assert (i.tolist(), j.tolist()) == ([0], [0])
    assert spelling.letter_counts(spelling.letters([a])).dtype == np.float64


def test_near_words_are_symmetric(spark):
    words = spark.createDataFrame([("wordings", 9), ("wordingz", 2), ("wording", 3), ("unlike", 1)], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_words(words).collect()}
    assert got == {(b, a) for a, b in got} == {(a, b) for a in ("wordings", "wordingz", "wording") for b in ("wordings", "wordingz", "wording") if a != b}
    assert spelling.near_words(words.where(F.lit(False))).count() == 0
