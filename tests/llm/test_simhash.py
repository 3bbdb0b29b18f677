from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallycast.llm import simhash as sh
from tallycast.llm.components import components


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, unsigned fingerprint)"""
    least = {}
    for i, p in prints:
        least[p] = min(i, least.get(p, i))
    nodes, root = list(least), {p: p for p in least}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(nodes):
        for b in nodes[k + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    best = {}
    for p, i in least.items():
        best[find(p)] = min(i, best.get(find(p), i))
    return {i: best[find(p)] for i, p in prints}


def signed_rows(prints):
    return [(i, sh.signed(p)) for i, p in prints]


def test_fingerprints():
    for text in [None, "", "  \t\n", "one", "A b C", "a b c d", "É É x a\x0bb\x0cc d e", "x " * 999, "Ärger ß " * 7 + "end"]:
        assert sh.fingerprint(text) == brute_fingerprint(text)


def test_report_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.report(docs).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints}


@pytest.mark.parametrize("block,small", [(2048, 32), (24, 4)])
def test_links_of_dense_and_chained_groups(spark, monkeypatch, block, small):
    """Copies of a centre with few flipped bits, chains, and noise; with small blocks hot buckets are dealt in blocks."""
    monkeypatch.setattr(sh, "BLOCK", block)
    monkeypatch.setattr(sh, "COUNTED", 1)
    monkeypatch.setattr(sh, "SMALL", small)
    rng = random.Random(9)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    centre, chain = rng.getrandbits(64), [rng.getrandbits(64)]
    values = [flip(centre, rng.randint(0, 3)) for _ in range(300)]
    for _ in range(60):
        chain.append(flip(chain[-1], 4))
    values += chain + [rng.getrandbits(64) for _ in range(300)] + [flip(values[5], 9), 0, (1 << 64) - 1]
    prints = list(enumerate(values))
    nodes = spark.createDataFrame(signed_rows([(i, p) for p, i in {p: i for i, p in prints}.items()]), "first long, fp long").select("fp", "first")
    label = {r.node: r.label for r in components(sh.links(nodes, sh.plan(nodes))).collect()}
    want = brute_components(prints)
    by_label = {}
    for i, p in prints:
        s = sh.signed(p)
        by_label.setdefault(label.get(s, s), []).append(i)
    assert {i: min(g) for g in by_label.values() for i in g} == want


def test_any_thresholds_find_all_pairs():
    rng = random.Random(4)
    for _ in range(50):
        m = rng.randint(2, 4)
        costs = [[rng.random() * 10 ** t for t in range(5)] for _ in range(m)]
        cost, picked = sh.allocate(costs, 4 - m + 1)
        assert sum(picked) == 4 - m + 1 and min(picked) >= -1
    assert sh.symmetric_sums([1.0] * 6, 3) == [1.0, 6.0, 15.0, 20.0]


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    groups = sh.group_bits(bits.T @ bits, len(bits), 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {16}
    assert any({3, 40} <= set(g) for g in groups)


def test_odd_tables(spark):
    rows = [(5, None, "x"), (3, "", "y"), (3, "", "y"), (None, "a b c d e f", "z"), (None, "q", "z"), (9, "a b c d e f", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in sh.report(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 9), (None, None), (9, 9)], key=str)
    assert sh.report(df.limit(0)).count() == 0


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(1, 1)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(100, 161)}) == 1 and len({got[i] for i in range(7, 60)}) == 1 and got[7] != got[100]
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
