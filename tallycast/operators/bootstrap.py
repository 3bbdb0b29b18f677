"""Cluster bootstrap with replicable draws, split down a tree of groups.

A replicate is exactly G draws of G groups with replacement. Groups are numbered in the order of their digest, and a
leaf is `LEAF` numbers in a row. At the root every slot of a replicate is sent to a leaf by arithmetic on (seed,
replicate, slot); a task counts a few replicates at a time, so only totals per (leaf, replicate) are shuffled. A leaf
then makes the draws of its own groups from its totals, next to their rows, which arrive sorted by leaf. No draw is
ever a shuffled row, and the result does not depend on partitions.

For sums, a task gives one row a replicate. For AUC, rows are summed per (group, scores) and a task adds up the drawn
weights of equal scores for all replicates, for as many scores as `WEIGHT_CELLS` allows; rows of further scores are
dealt with their draw counts, added up where a batch has `ALIKE` of one score. Coarse score levels give three numbers
a replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.operators.metrics import clipped, log_loss_of
from tallycast.session import cut

BOOT_LEVELS = 1024
#: Sums that a task holds at most, of all its scores and replicates.
WEIGHT_CELLS = 8_000_000
#: Groups of a leaf.
LEAF = 1024
#: Rows with one score in a batch from which they are added up.
ALIKE = 16
#: Replicates that a task counts at a time, slots of them at a time, and rows that meet their draw counts at a time.
TOGETHER, SLOTS, ROWS = 8, 1 << 14, 1 << 10
#: Scores of one batch up to which their sums are one product of matrices.
FEW = 32
# An invertible mixing of 31-bit numbers; the SQL texts spell it out too.
MASK, FIRST, SECOND = (1 << 31) - 1, 0x7FEB352D, 0x046CA68B


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 31 bits, as uint32, mixed; products wrap, which leaves their low 31 bits as they are."""
    x = x * np.uint32(FIRST)
    x &= np.uint32(MASK)
    x ^= x >> np.uint32(15)
    x *= np.uint32(SECOND)
    x &= np.uint32(MASK)
    x ^= x >> np.uint32(13)
    return x


def replicate_keys(b: np.ndarray, seed: int) -> np.ndarray:
    return mixed(((b + (seed * 7919 + 1) % MASK) & MASK).astype(np.uint32))


def numbered_rows(df: DataFrame, group: str, columns: list[str]) -> tuple[DataFrame, int]:
    """(idx, columns) of the rows of `df`, and the number of groups: idx counts the groups from 0 in the order of the
    md5 of `group`, NULL is a group too. Rows are dealt by the head of the digest and written once."""
    digest = F.unhex(F.md5(F.col(group).cast("string"))).alias("__digest")
    marked = df.select(digest, *columns).withColumn("__head", F.coalesce(F.substring("__digest", 1, 2), F.unhex(F.lit(""))))
    ranked = marked.withColumn("__rank", F.dense_rank().over(W.partitionBy("__head").orderBy("__digest")).cast("long"))
    stored = cut(ranked.select("__head", "__rank", *columns))
    heads = stored.groupBy("__head").agg(F.max("__rank").alias("groups"))
    before = F.coalesce(F.sum("groups").over(W.orderBy("__head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = cut(heads.select(F.col("__head").alias("__at"), "groups", before.alias("before")))
    n_groups = places.agg(F.sum("groups")).first()[0] or 0
    joined = stored.join(places, F.col("__head") == F.col("__at"))
    return joined.select((F.col("before") + F.col("__rank") - 1).alias("idx"), *columns), n_groups


def leaf_totals(spark: SparkSession, n_groups: int, n_boot: int, seed: int) -> DataFrame:
    """(leaf, b, totals): the draws of each leaf in the replicates from b on, as 32-bit numbers."""
    width, together, slots = LEAF, TOGETHER, SLOTS
    leaves = -(-n_groups // width)

    def counted(b: int) -> np.ndarray:
        key, out = replicate_keys(np.array([b]), seed), np.zeros(leaves, np.int64)
        for first in range(0, n_groups, slots):
            ids = (np.arange(first, min(first + slots, n_groups)) & MASK).astype(np.uint32)
            high = mixed(ids ^ key)
            low = mixed((high + key) & np.uint32(MASK))
            number = (high.astype(np.uint64) << np.uint64(31)) | low
            number -= number // np.uint64(n_groups) * np.uint64(n_groups)
            out += np.bincount((number // np.uint64(width)).astype(np.int64), minlength=leaves)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                some = np.array([counted(b) for b in range(first, min(first + together, n_boot))]).astype(np.uint32).T
                for at in range(0, leaves, 4096):
                    part = np.ascontiguousarray(some[at:at + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at + np.arange(len(part))), pa.array(np.full(len(part), first)), pa.array([x.tobytes() for x in part], pa.binary())], names=["leaf", "b", "totals"])

    parts = -(-n_boot // together)
    return spark.range(0, n_boot, together, parts).mapInArrow(run, "leaf long, b long, totals binary")


def leaf_draws(leaf: int, n_groups: int, totals: np.ndarray, seed: int, width: int) -> np.ndarray:
    """Draw counts (groups x replicates) of one leaf of `width` groups, or what is left of them."""
    size, n_boot = min(width, n_groups - leaf * width), len(totals)
    keys = mixed(replicate_keys(np.arange(n_boot), seed) ^ np.uint32(leaf + 1 & MASK))
    out = np.empty((size, n_boot))
    for first in range(0, n_boot, 32):
        c = totals[first:first + 32]
        slot = np.arange(c.max())
        picked = mixed((slot & MASK).astype(np.uint32) ^ keys[first:first + 32, None])
        picked = picked & np.uint32(size - 1) if size & (size - 1) == 0 else picked % np.uint32(size)
        cells = picked.astype(np.int64) * len(c) + np.arange(len(c))[:, None]
        out[:, first:first + 32] = np.bincount(cells[slot < c[:, None]], minlength=size * len(c)).reshape(size, len(c))
    return out


Slices = Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]


def at_leaves(rows: DataFrame, n_groups: int, n_boot: int, seed: int, use: Callable[[Slices], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `use` makes of the (draw counts of a leaf, places in it, rows) of each task. The totals of a leaf and its
    `rows` (idx and further columns) go to one task, sorted by leaf, totals first; the state is one leaf."""
    spark, width = rows.sparkSession, LEAF
    names = [c for c in rows.columns if c != "idx"]
    leaf = F.floor(F.col("idx") / width).alias("leaf")
    totals = leaf_totals(spark, n_groups, n_boot, seed).select("leaf", "b", "totals", F.lit(None).cast("long").alias("idx"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names])
    members = rows.select(leaf, F.lit(None).cast("long").alias("b"), F.lit(None).cast("binary").alias("totals"), "idx", *names)
    dealt = totals.unionByName(members).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "leaf").sortWithinPartitions("leaf", F.col("b").isNull())

    def slices(batches: Iterator[pa.RecordBatch]) -> Slices:
        at, sums, counts = None, None, None
        for batch in batches:
            leaves, of = batch.column("leaf").to_numpy(), batch.column("totals")
            cuts = np.flatnonzero(np.concatenate(([True], leaves[1:] != leaves[:-1]))).tolist() if len(leaves) else []
            for first, end in zip(cuts, [*cuts[1:], len(leaves)]):
                if leaves[first] != at:
                    at, sums, counts = int(leaves[first]), np.zeros(n_boot, np.int64), None
                given = len(of.slice(first, end - first)) - of.slice(first, end - first).null_count
                for b, x in zip(batch.column("b").slice(first, given).to_pylist(), of.slice(first, given).to_pylist()):
                    part = np.frombuffer(x, np.uint32)
                    sums[b:b + len(part)] = part
                if first + given < end:
                    if counts is None:
                        counts = leaf_draws(at, n_groups, sums, seed, width)
                    own = batch.slice(first + given, end - first - given)
                    yield counts, own.column("idx").to_numpy() - at * width, own

    return dealt.mapInArrow(lambda batches: use(slices(batches)), schema)


def draw_vectors(spark: SparkSession, n_groups: int, n_boot: int, seed: int) -> DataFrame:
    """(idx, drawn): how often each replicate draws a group, as 16-bit numbers."""
    def run(found: Slices) -> Iterator[pa.RecordBatch]:
        for counts, place, rows in found:
            drawn = counts[place].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([rows.column("idx"), pa.array([x.tobytes() for x in drawn], pa.binary())], names=["idx", "drawn"])

    return at_leaves(spark.range(n_groups).select(F.col("id").alias("idx")), n_groups, n_boot, seed, run, "idx long, drawn binary")


def interval(replicates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """2.5 and 97.5 percentiles (linear) and the share at or below zero; one row per replicate goes in."""
    return replicates.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        F.avg((F.col(value) <= 0).cast("int")).alias("p_value"),
        F.count(F.lit(1)).alias("replicates"),
    ).select(*keys, F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"), "p_value", "replicates")


def _sums_of_equal(counts: np.ndarray, place: np.ndarray, weight: np.ndarray, slot: np.ndarray, sums: np.ndarray) -> None:
    """Adds the drawn weights of the rows to the row of `sums` (place 0: weight one) that `slot` names."""
    used = np.flatnonzero(weight != 0)
    place, weight, slot = place[used], weight[used], slot[used]
    found, of = np.unique(slot, return_inverse=True)
    if len(found) <= FEW:  # few scores of many rows: a product of matrices
        parts = np.zeros((len(found), len(counts)))
        np.add.at(parts, (of, place), weight)
        sums[found, 1:] += parts @ counts
    else:  # the first rows of all scores, then the second ones, and so on
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))
        turn = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        for k in range(turn.max() + 1):
            rows = order[turn == k]
            for first in range(0, len(rows), ROWS):
                some = rows[first:first + ROWS]
                drawn = counts[place[some]]
                if (weight[some] != 1).any():
                    drawn *= weight[some][:, None]
                sums[slot[some], 1:] += drawn
    np.add.at(sums[:, 0], slot, weight)


def _score_sums(found: Slices, n_boot: int, held: int, alike: int) -> Iterator[pa.RecordBatch]:
    """(which, score, pos, neg, drawn, pos_sums, neg_sums): sums of equal scores over a task for the first `held`
    scores; of further ones sums over a batch where `alike` rows share a score, and single rows with draw counts."""
    slots: dict[tuple[str, float], int] = {}
    sums = [np.zeros((0, n_boot + 1)), np.zeros((0, n_boot + 1))]
    names = ["which", "score", "pos", "neg", "drawn", "pos_sums", "neg_sums"]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]

    def rows(which, score, pos=None, neg=None, drawn=None, totals=None):
        none = [None] * len(score)
        both = [[x.tobytes() for x in t] for t in totals] if totals else [none, none]
        columns = [[which] * len(score) if isinstance(which, str) else which, score, none if pos is None else pos, none if neg is None else neg, none if drawn is None else drawn, *both]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for counts, place, own in found:
        pos, neg = own.column("pos").to_numpy(), own.column("neg").to_numpy()
        for which in ("base", "new"):
            score = own.column(which).to_numpy(zero_copy_only=False)
            values, of = np.unique(score, return_inverse=True)
            for v in values.tolist():
                if len(slots) < held:
                    slots.setdefault((which, v), len(slots))
            slot = np.array([slots.get((which, v), -1) for v in values.tolist()], np.int64)
            if len(slots) > len(sums[0]):
                more = np.zeros((max(64, 2 * len(slots)) - len(sums[0]), n_boot + 1))
                sums = [np.concatenate((s, more)) for s in sums]
            known = slot[of] >= 0
            for s, w in zip(sums, (pos, neg)):
                _sums_of_equal(counts, place[known], w[known], slot[of][known], s)
            sizes = np.bincount(of, minlength=len(values))
            many = np.flatnonzero((slot < 0) & (sizes >= alike))
            for at in range(0, len(many), ROWS):
                some = many[at:at + ROWS]
                here = np.full(len(values), -1)
                here[some] = np.arange(len(some))
                mine = here[of] >= 0
                both = [np.zeros((len(some), n_boot + 1)) for _ in range(2)]
                for s, w in zip(both, (pos, neg)):
                    _sums_of_equal(counts, place[mine], w[mine], here[of][mine], s)
                yield rows(which, values[some], totals=both)
            few = np.flatnonzero(((slot < 0) & (sizes < alike))[of])
            for at in range(0, len(few), ROWS):
                some = few[at:at + ROWS]
                vectors = counts[place[some]]
                vectors = vectors.astype(np.uint8 if vectors.max(initial=0) < 256 else np.uint32)
                yield rows(which, score[some], pos[some], neg[some], [x.tobytes() for x in vectors])
    keys = list(slots)
    for at in range(0, len(keys), 256):
        part = keys[at:at + 256]
        yield rows([w for w, _ in part], [v for _, v in part], totals=[s[at:at + len(part)] for s in sums])


def _weights(part: pd.DataFrame, n_boot: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted positives and negatives of rows, for each replicate; place 0 has weight one everywhere."""
    out = np.zeros((2, len(part), n_boot + 1))
    single = part["drawn"].notna().to_numpy()
    for i in np.flatnonzero(single):
        raw = part["drawn"].iloc[i]
        drawn = np.frombuffer(raw, np.uint8 if len(raw) == n_boot else np.uint32)
        for side, c in enumerate(("pos", "neg")):
            out[side, i, 0] = part[c].iloc[i]
            out[side, i, 1:] = drawn * part[c].iloc[i]
    for i in np.flatnonzero(~single):
        for side, c in enumerate(("pos_sums", "neg_sums")):
            out[side, i] = np.frombuffer(part[c].iloc[i], float)
    return out[0], out[1]


def _level_sums(batches: Iterator[pd.DataFrame], n_boot: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (which, lvl, score) into one row per (which, lvl): weighted positives and negatives, and
    pairs within the level, for each replicate; place 0 has weight one everywhere. The state is one level."""
    def fresh():
        return [np.zeros(n_boot + 1) for _ in range(5)]  # pos, neg, pairs; pos, neg of the score at hand

    def close(sums):
        sums[2] += sums[3] * (sums[1] + sums[4] / 2)
        sums[0] += sums[3]
        sums[1] += sums[4]
        sums[3], sums[4] = np.zeros(n_boot + 1), np.zeros(n_boot + 1)

    def row(at, sums):
        return pd.DataFrame({"which": pd.Series([at[0]], dtype=object), "lvl": [at[1]], "pos": [sums[0]], "neg": [sums[1]], "pairs": [sums[2]]})

    at, score, sums = None, None, fresh()
    for batch in batches:
        for first in range(0, len(batch), 1024):
            part = batch.iloc[first:first + 1024]
            all_pos, all_neg = _weights(part, n_boot)
            which, lvl, scores = part["which"].to_numpy(), part["lvl"].to_numpy(), part["score"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (lvl[1:] != lvl[:-1]) | (scores[1:] != scores[:-1]))))
            pos, neg = np.add.reduceat(all_pos, cuts), np.add.reduceat(all_neg, cuts)
            for k, i in enumerate(cuts):
                here = (which[i], lvl[i])
                if here != at:
                    if at is not None:
                        close(sums)
                        yield row(at, sums)
                    at, score, sums = here, scores[i], fresh()
                elif scores[i] != score:
                    close(sums)
                    score = scores[i]
                sums[3] += pos[k]
                sums[4] += neg[k]
    if at is not None:
        close(sums)
        yield row(at, sums)


def bootstrap_auc_diff(
    df: DataFrame, base: str, new: str, group: str, n_boot: int = 1000, seed: int = 42, y: str = "outcome",
    weight: str | None = None,
) -> DataFrame:
    """AUC(new) - AUC(base): point, 95 % interval over resampled groups, share of replicates <= 0.

    Replicates that hold one class only drop out.
    """
    w = F.col(weight) if weight else F.lit(1)
    scores = df.select(group, clipped(base, 0.0).alias("base"), clipped(new, 0.0).alias("new"), (w * F.col(y)).alias("wp"), (w * (1 - F.col(y))).alias("wn"))
    sums = scores.groupBy(group, "base", "new").agg(*[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(n) for c, n in (("wp", "pos"), ("wn", "neg"))])
    spark = df.sparkSession
    rows, n_groups = numbered_rows(sums, group, ["base", "new", "pos", "neg"])
    held, alike = WEIGHT_CELLS // (2 * n_boot + 2), ALIKE
    found = at_leaves(
        rows, n_groups, n_boot, seed, lambda found: _score_sums(found, n_boot, held, alike),
        "which string, score double, pos double, neg double, drawn binary, pos_sums binary, neg_sums binary")
    levelled = found.withColumn("lvl", F.floor(F.col("score") * BOOT_LEVELS))
    dealt = levelled.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "which", "lvl").sortWithinPartitions("which", "lvl", "score")
    levels = dealt.mapInPandas(
        lambda batches: _level_sums(batches, n_boot), "which string, lvl long, pos array<double>, neg array<double>, pairs array<double>")
    cells = levels.select("which", "lvl", F.posexplode(F.arrays_zip("pos", "neg", "pairs")).alias("b", "s")).select("which", "lvl", "b", "s.*")
    below = F.coalesce(F.sum("neg").over(W.partitionBy("which", "b").orderBy("lvl").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    each = cells.withColumn("pairs", F.col("pairs") + F.col("pos") * below).groupBy("which", "b").agg(
        F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("auc"))
    side = lambda k: F.max(F.when(F.col("which") == k, F.col("auc")))
    diffs = each.groupBy("b").agg((side("new") - side("base")).alias("diff"))
    point = F.max(F.when(F.col("b") == 0, F.col("diff"))).alias("point")
    replicate = F.when(F.col("b") > 0, F.col("diff"))
    return diffs.agg(
        F.percentile(replicate, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((replicate <= 0).cast("int")).alias("p_value"),
        F.count(replicate).alias("replicates"), point,
    ).select(F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"), "p_value", "replicates", "point")


def bootstrap_ratio(
    per_group: DataFrame, group: str, ratios: dict[str, tuple[str, str]], n_boot: int, seed: int = 42
) -> DataFrame:
    """Intervals of sum(numerator) / sum(denominator) over resampled groups, one row per ratio.

    `per_group` has one row per group, so a leaf's share of each replicate is a product of its draw counts and its
    groups' values, added up over the leaves of a task. Missing values count as nothing.
    """
    needed = sorted({c for pair in ratios.values() for c in pair})
    doubles = per_group.select(group, *[F.col(c).cast("double").alias(c) for c in needed])
    numbered, n_groups = numbered_rows(doubles, group, needed)

    def leaf_sums(found: Slices) -> Iterator[pa.RecordBatch]:
        out = np.zeros((n_boot, len(needed)))
        for counts, place, rows in found:
            values = np.stack([rows.column(c).fill_null(0.0).to_numpy() for c in needed], 1)
            sound = np.isfinite(values).all(1)
            out += counts[place[sound]].T @ values[sound]
            for i in np.flatnonzero(~sound):  # counts only where it is drawn
                out[counts[place[i]] > 0] += values[i]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), *(pa.array(c) for c in out.T)], names=["b", *needed])

    sums = [F.sum(c).alias(c) for c in needed]
    schema = ", ".join(["b long", *(f"`{c}` double" for c in needed)])
    resampled = at_leaves(numbered, n_groups, n_boot, seed, leaf_sums, schema).groupBy("b").agg(*sums)

    def long(t: DataFrame, keep: list[str]) -> DataFrame:
        rows = [F.struct(F.lit(n).alias("measure"), F.try_divide(F.col(a), F.col(b)).alias("value"))
                for n, (a, b) in ratios.items()]
        return t.select(*keep, F.inline(F.array(*rows)))

    point = long(numbered.agg(*sums), []).select("measure", F.col("value").alias("point"))
    return interval(long(resampled, ["b"]), ["measure"], "value").join(point, "measure")


def bootstrap_loss_diff(
    df: DataFrame, base: str, new: str, group: str, n_boot: int = 1000, seed: int = 42, y: str = "outcome",
    weight: str | None = None,
) -> DataFrame:
    """Log-loss and Brier differences (new - base) with intervals; negative means the new score is better."""
    w: Column = F.col(weight) if weight else F.lit(1)
    pb, pn, yes = clipped(base), clipped(new), F.col(y)
    per_group = df.groupBy(group).agg(
        F.sum(w * (log_loss_of(new, y) - log_loss_of(base, y))).alias("d_log_loss"),
        F.sum(w * ((pn - yes) * (pn - yes) - (pb - yes) * (pb - yes))).alias("d_brier"),
        F.sum(w.cast("double")).alias("weight_sum"),
    )
    return bootstrap_ratio(
        per_group, group, {"log_loss": ("d_log_loss", "weight_sum"), "brier": ("d_brier", "weight_sum")}, n_boot, seed
    )
