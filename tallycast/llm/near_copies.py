"""Near copies by the exact similarity of word shingles, for the pipeline.

Two texts are near copies if the sets of their five-word shingles (words as in `simhash`: A-Z lower-cased, between
white space; all words, if fewer than five) have a Jaccard similarity of at least `SIMILAR`.

1. Texts with equal sets are one node. Its SimHash fingerprint, of five-word shingles, is linked by op8's method
   (`simhash.plan`, `simhash.links`) to those within `simhash.DISTANCE` bits. A node also has `BANDS` band keys of
   `ROWS` minimum hashes each, for copies whose fingerprints lie further apart; two nodes of similarity 0.8 share no
   band with a probability of (1 - 0.8^5)^40 = 1.2e-7, more similar ones with less.
2. Nodes with linked or equal fingerprints, or that share a band, are proposed to each other. What proposals connect is a cluster, so every proposed pair
   lies within one. Nodes outside of clusters are done; only the texts of the others are dealt, once each.
3. In a cluster, exact similarities decide: a search from text to text gives links that connect whatever chains of
   similar texts connect. A cluster of more than about `BLOCK` shingles is dealt in blocks, and each two blocks meet
   in a task, so no task holds a whole group and no pair is left out.
Components are those of the confirmed links, each named by its least doc_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm import simhash
from tallycast.llm.common import add_columns, written
from tallycast.llm.components import components
from tallycast.llm.simhash import signed

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, ROWS = 40, 5
BLOCK, CHUNK = 1 << 18, 1 << 10
#: Odd factors of the minimum hashes, and those that join the minima of a band.
TURNS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
JOINS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1:].tolist())), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The band keys of a set; none of the empty one."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(TURNS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at:at + CHUNK, None] * TURNS).min(axis=0))
    mixed = least.reshape(BANDS, ROWS)
    mixed = ((mixed ^ (mixed >> np.uint64(29))) * JOINS).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, n, fp, bands) for each row: digests of text and set, size of the set, fingerprint, band keys."""

    def made(texts: list[str | None]) -> list[pa.Array]:
        found = [shingles(x) for x in texts]
        return [
            pa.array([signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in found], pa.int64()),
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([signed(simhash.fingerprint(x, SHINGLE)) for x in texts], pa.int64()),
            pa.array([bands(x) for x in found], pa.list_(pa.int64())),
        ]

    kinds = {"node": T.LongType(), "n": T.LongType(), "fp": T.LongType(), "bands": T.ArrayType(T.LongType())}
    slim = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return add_columns(slim, "text", lambda: made, [T.StructField(c, kind) for c, kind in kinds.items()])


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes that connect all whose fingerprints are equal or linked within `simhash.DISTANCE` bits."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    equal = nodes.join(prints, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    found = simhash.links(prints.select("fp"), simhash.plan(prints.select("fp")))
    named = lambda x: prints.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_node"))
    linked = found.join(named("a"), "a").join(named("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return equal.unionByName(linked)


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, cluster) of the nodes that proposals reach."""
    rows = written(nodes.select("node", F.explode("bands").alias("band")), "bands")
    shared = rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    pairs = rows.join(shared, "band").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return components(pairs.unionByName(fingerprint_pairs(nodes)).distinct()).select("node", F.col("label").alias("cluster"))


def similar(found: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (places in `found`) between sets of similarity `SIMILAR` or more that connect all whom chains connect."""
    sizes = np.array([len(x) for x in found], np.int64)
    _, ids = np.unique(np.concatenate(found), return_inverse=True)
    ends = np.cumsum(sizes)
    rest, owner = ids, np.repeat(np.arange(len(found)), sizes)
    mark, left, a, b = np.zeros(len(ids), bool), np.ones(len(found), bool), [], []
    n = looked_at = len(found)
    for begin in range(len(found)):
        if not left[begin]:
            continue
        left[begin], n, frontier = False, n - 1, [begin]
        while frontier and n:
            at = frontier.pop()
            if 2 * n < looked_at:
                keep = left[owner]
                rest, owner, looked_at = rest[keep], owner[keep], n
            own = ids[ends[at] - sizes[at]:ends[at]]
            mark[own] = True
            common = np.bincount(owner[mark[rest]], minlength=len(found))
            mark[own] = False
            # common / (sizes - common) >= 0.8 in whole numbers
            hit = np.flatnonzero(left & (9 * common >= 4 * (sizes + sizes[at]))).tolist()
            left[hit], n = False, n - len(hit)
            a += [at] * len(hit)
            b += hit
            frontier += hit
    return a, b


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of nodes; `docs` has h and text."""
    found = written(nodes.join(clusters(nodes), "node").select("node", "h", "n", "cluster"), "clusters")
    size = found.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))
    split = found.join(size, "cluster").withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(others)))
    dealt = split.select("h", "node", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("deal"))
    texts = docs.join(found.select("h"), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node = group["node"].to_numpy(np.int64)
        a, b = similar([shingles(x) for x in group["text"]])
        return pd.DataFrame({"a": node[a], "b": node[b]}, dtype=np.int64)

    return dealt.join(texts, "h").select("deal", "node", "text").groupBy("deal").applyInPandas(run, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, h, component_id, component_h for each row of `docs` (doc_id, text; further columns are ignored): h is the
    xxhash64 of the text, and the least (doc_id, h) names a component, so rows of one id with different texts stay apart.
    Null texts count as empty, and all empty texts share one component; a null doc_id names one only where it has no other."""
    prints = written(sets(docs), "sets")
    nodes = written(prints.groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first"), F.min("h").alias("h"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    label = components(links(docs.select(F.xxhash64("text").alias("h"), "text"), nodes))
    named = nodes.select("node", "first").join(label, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    named = written(named, "named")
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    final = written(named.join(least, "label").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.h").alias("component_h")), "final")
    return prints.join(final, "node").select("doc_id", "h", "component_id", "component_h")
