"""SimHash near duplicates by the generalised pigeonhole principle.

Fingerprints: A-Z lower-cased, words between white space, shingles of `SHINGLE` words with repeats (all words, if
fewer), XXH64 with seed 42 of each; a bit is set if it is set in over half the hashes. No words give zero.

Links between the distinct fingerprints (copies fall together first):
1. One pass counts how often each bit, and each two bits, are set. Correlated bits are grouped, for 2, 3 and 4
   parts, so that the parts are as independent as can be.
2. With m parts and thresholds t_i >= -1 that sum to DISTANCE - m + 1, two fingerprints within DISTANCE differ in at
   most t_i bits in some part i (-1: the part isn't searched). Exact counts of pairs that agree on a part, and the
   agreement of each bit, estimate the candidates of every threshold; dynamic programming takes the cheapest split.
3. Probes: a part with threshold t is masked in every choice of t of its bits; fingerprints with one masked value
   share a bucket. Buckets are sorted streams in the tasks; a pair is verified by the differing bits of the whole.
   Small buckets compare each with each; larger ones search breadth-first and give a spanning forest, not all pairs.
4. A bucket of more than about `BLOCK` is dealt in blocks, and each two blocks meet in a task: no group is unbounded
   and no pair is left out. Bucket sizes for that are counted on one in `COUNTED` fingerprints; they decide the
   dealing only.
Components are then found by contraction, and each is named by its least doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.common import add_columns, written
from tallycast.llm.components import components

SHINGLE, DISTANCE, BITS, SEED = 4, 4, 64, 42
PARTS = (2, 3, 4)
BLOCK, COUNTED, SMALL = 2048, 8, 32
#: Rows of hot buckets up to which they are broadcast; with more the join shuffles.
BROADCAST_ROWS = 100_000
#: Cost of comparing a candidate pair, in units of shuffling a probe.
PAIR_COST = 0.02
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; a row for each row."""

    def start():
        return lambda texts: [pa.array([signed(fingerprint(x, shingle)) for x in texts], pa.int64())]

    return add_columns(docs.select("doc_id", "text"), "text", start, [T.StructField("fp", T.LongType())])


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many set bits i and j both (64 x 64)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            x = batch["fp"].to_numpy(np.int64)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(x)
        yield pd.DataFrame({"n": [n], "total": [total.ravel().tolist()]})

    rows = nodes.select("fp").mapInPandas(run, "n long, total array<long>")
    summed = rows.select("n", F.posexplode("total").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out, n = np.zeros(BITS * BITS, np.int64), 0
    for r in summed.collect():
        out[r["at"]], n = r["x"], r["n"]
    return n, out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m groups of nearly equal size, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def mask_of(bits: list[int] | tuple[int, ...]) -> int:
    return signed(sum(1 << b for b in bits))


def equal_pairs(nodes: DataFrame, masks: list[int]) -> list[float]:
    """For each mask, the pairs of fingerprints that agree on it."""
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("i", "mask")).select("i", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    counts = keyed.groupBy("i", "key").count().groupBy("i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    out = [0.0] * len(masks)
    for r in counts.collect():
        out[r["i"]] = r["pairs"]
    return out


def symmetric_sums(values: list[float], most: int) -> list[float]:
    """Elementary symmetric sums of degree 0 to `most`."""
    out = [1.0] + [0.0] * most
    for v in values:
        for t in range(most, 0, -1):
            out[t] += v * out[t - 1]
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 of sum `total` with the least cost; costs[i][t] for t >= 0, and -1 is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for at, (cost, picked) in best.items():
            for t in range(-1, len(row)):
                new = (cost + (row[t] if t >= 0 else 0.0), [*picked, t])
                if at + t not in step or new < step[at + t]:
                    step[at + t] = new
        best = step
    return best[total]


def plan(nodes: DataFrame, distance: int = DISTANCE) -> list[int]:
    """The masks to probe with, by the cheapest grouping and thresholds."""
    n, both = bit_counts(nodes)
    agree = 1 - 2 * (p := np.diag(both) / max(n, 1)) * (1 - p)
    grouped = {m: group_bits(both, n, m) for m in PARTS}
    flat = [(m, g) for m in PARTS for g in grouped[m]]
    pairs = iter(equal_pairs(nodes, [mask_of(g) for _, g in flat]))
    options = []
    for m in PARTS:
        costs, most = [], distance - m + 1 + m - 1
        for g in grouped[m]:
            alike, factors = next(pairs), symmetric_sums([1 / agree[b] for b in g], most)
            costs.append([n * math.comb(len(g), t) + PAIR_COST * alike * factors[t] for t in range(most + 1)])
        cost, picked = allocate(costs, distance - m + 1)
        options.append((cost, m, picked))
    _, m, picked = min(options)
    return [mask_of([b for b in g if b not in out]) for g, t in zip(grouped[m], picked) if t >= 0 for out in combinations(g, t)]


def forest(x: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all members of a bucket whom chains of links connect."""
    rest, out = x, []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                hit, rest = rest[near], rest[~near]
                out.append((np.full(len(hit), at), hit))
                frontier.extend(hit)
    return out


def bucket_links(keys: np.ndarray, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of a batch sorted by key; fingerprints as signed numbers in and out."""
    x = x.view(np.uint64)  # bits of a negative number are not counted as they stand
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((cuts, [len(keys)])))
    small = np.repeat(sizes <= SMALL, sizes)
    found = []
    for k in np.flatnonzero(sizes > SMALL):
        found += forest(np.unique(x[cuts[k]:cuts[k] + sizes[k]]), distance)
    at = np.flatnonzero(small)
    for d in range(1, SMALL):
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count(x[at] ^ x[at + d]) <= distance]
        found.append((x[near], x[near + d]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]).view(np.int64), np.concatenate([b for _, b in found]).view(np.int64)


def links(nodes: DataFrame, masks: list[int], distance: int = DISTANCE) -> DataFrame:
    """Verified links (a, b) that connect all fingerprints within `distance` of each other, directly or by chains."""
    spark = nodes.sparkSession

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("i", "mask")).select("fp", F.xxhash64("i", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))

    some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0)
    sizes = keyed(some).groupBy("bucket").count().where(F.col("count") * COUNTED > BLOCK)
    hot = written(sizes.select("bucket", (F.ceil(F.col("count") * COUNTED / BLOCK) + 1).cast("int").alias("blocks")), "hot")
    rows, n_hot = keyed(nodes), hot.count()
    if n_hot:
        dealt = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "bucket", "left")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))
        split = dealt.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(others)))
        key = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
        rows = split.select("fp", key.alias("bucket"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, x = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch["bucket"].to_numpy(np.int64)))
            x = np.concatenate((x, batch["fp"].to_numpy(np.int64)))
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if whole:
                a, b = bucket_links(keys[:whole], x[:whole], distance)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
                keys, x = keys[whole:], x[whole:]
        if len(keys):
            a, b = bucket_links(keys, x, distance)
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(shuffles, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for each row of `docs` (doc_id, text; further columns are ignored).

    component_id is the least doc_id that links reach. Null texts count as empty; all empty texts share fingerprint
    zero and one component. A null doc_id names a component only where it has no other id (then null). Repeated
    rows stay repeated. An empty table gives an empty result."""
    prints = written(fingerprints(docs, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    label = components(links(nodes, plan(nodes, distance), distance))
    named = nodes.join(label, nodes.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = written(named, "named")
    least = written(named.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    final = written(named.join(least, "label").select("fp", "component_id"), "final")
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
