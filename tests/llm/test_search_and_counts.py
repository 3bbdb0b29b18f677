from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import regex

from tallycast.llm import bpe, neighbours, token_counts


def brute(rows, every=20, top=20):
    vec = {}
    for i, x in rows:
        if i is None or x is None or not len(x) or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            continue
        vec[i] = min(vec.get(i, x), x)
    out = {}
    for q, x in vec.items():
        if q % every == 0:
            score = {i: sum_in_order(x, y) for i, y in vec.items() if i != q and len(y) == len(x)}
            out[q] = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:top]
    return out


def sum_in_order(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += float(a) * float(b)
    return total


def test_recall_and_exact_scores_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, [float(np.float32(v)) for v in r.embedding]) for r in df.collect()])
    got = {}
    for r in sorted(neighbours.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    print("recall", recall)
    assert recall >= 0.98
    exact = {q: dict(brute_all) for q, brute_all in want.items()}
    assert all(exact[q].get(i, s) == s for q, found in got.items() for i, s in found)


def test_ties_odd_vectors_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "GROUP", 2)
    rng = random.Random(2)
    same = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(100)] + [(i, same) for i in range(100, 161)]
    rows += [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [None] * 8), (280, [1.0] * 3), (281, [2.0] * 3), (300, []), (None, same), (100, same), (320, [float("inf")] * 8), (2, rows[2][1])]
    df = spark.createDataFrame([(i, x, 1.0) for i, x in rows], "vec_id long, embedding array<double>, score double")
    for limit in (1 << 30, -1):
        monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)
        got = {}
        for r in sorted(neighbours.search(df, top=20).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        want = brute(rows)
        assert got.keys() == want.keys() and got[280] == want[280] and got[120] == want[120]
        assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) > 0.95
    assert neighbours.search(df.limit(0)).count() == 0


def brute_count(data, score):
    best = [(0, 0)]
    for i in range(1, len(data) + 1):
        best.append(max((best[j][0] + score[data[j:i]], best[j][1] - 1) for j in range(i) if data[j:i] in score))
    return -best[-1][1]


def test_counts_equal_a_plain_programme(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 300)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    score = token_counts.scores(bpe.load_ranks(path))
    assert abs(sum(np.exp(s / 1e6) for s in score.values()) - 1) < 1e-3
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, r.text[:3000], 1) for r in docs] + [(900, None, 1), (901, "", 1), (901, "", 1), (None, "a" * 700 + " 日本語🙂 \n\n  x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens, r.n_pretokens) for r in token_counts.count(df, path, public_tokenizers.PATTERN).collect()), key=str)
    known, want = {}, []
    for i, text, _ in rows:
        pieces = regex.findall(public_tokenizers.PATTERN, text or "")
        for p in pieces:
            if p not in known:
                known[p] = brute_count(p.encode(), score)
        want.append((i, sum(known[p] for p in pieces), len(pieces)))
    assert got == sorted(want, key=str)
    assert token_counts.count(df.limit(0), path, public_tokenizers.PATTERN).count() == 0
