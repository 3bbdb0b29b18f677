"""Running sums and ranks that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL; the keys come from the left."""
    place = F.struct(*keys).alias("__keys")
    slim = right.select(place, *[c for c in right.columns if c not in keys])
    return left.withColumn("__keys", place).join(slim, "__keys", how).drop("__keys")


def running_sums(
    df: DataFrame, keys: list[str], levels: list[str], order: list, sums: dict[str, Column], totals: bool = False
) -> DataFrame:
    """Inclusive running sums in the order `levels..., order` within `keys`.

    `levels` are columns that never decrease along the order, from coarse to fine. The window sorts
    only inside one finest bucket; bucket totals are a map-side combined aggregate, and their own
    running sums, joined once, add the offset. NULL keys and levels are groups of their own. With `totals`, `tot_<name>` carries the sum of the whole group.
    """
    names, deepest = list(sums), len(levels)
    # keys inside a struct compare null-safe, so a NULL key or level keeps its rows
    base = df.select("*", F.struct(*keys, *levels).alias("__place"), *[sums[n].alias(f"in_{n}") for n in names])
    inside = W.partitionBy("__place").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = base.select("*", *[F.sum(f"in_{n}").over(inside).alias(f"run_{n}") for n in names])
    bucket = base.groupBy("__place").agg(*[F.sum(f"in_{n}").alias(n) for n in names])
    bucket = bucket.select(*[F.col(f"__place.`{c}`").alias(c) for c in [*keys, *levels]], *names)
    offsets = bucket
    for depth in range(deepest, 0, -1):
        part, level = keys + levels[: depth - 1], levels[depth - 1]
        before = W.partitionBy(*part).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        cols = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"off{depth}_{n}") for n in names]
        if totals and depth == 1:
            cols += [F.sum(n).over(W.partitionBy(*part)).alias(f"tot_{n}") for n in names]
        at = F.struct(*part, level).alias(f"__at{depth}")
        if depth == deepest:
            offsets = bucket.select(F.struct(*keys, *levels).alias("__place"), at, *cols)
        else:
            offsets = offsets.withColumn(f"__at{depth}", F.struct(*[F.col(f"__place.`{c}`").alias(c) for c in [*part, level]])).join(
                bucket.select(at, *cols), f"__at{depth}")
        if depth > 1:
            bucket = bucket.groupBy(*part).agg(*[F.sum(n).alias(n) for n in names])
    out = out.join(offsets, "__place")
    kept = [c for c in df.columns if c not in levels]
    result = []
    for n in names:
        total = F.col(f"run_{n}")
        for depth in range(1, deepest + 1):
            total = total + F.col(f"off{depth}_{n}")
        result.append(total.alias(n))
    if totals:
        result += [F.col(f"tot_{n}") for n in names]
    return out.select(*kept, *result)


def running_rank(df: DataFrame, keys: list[str], levels: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based position within `keys`; `tot_<name>` is the group's row count."""
    return running_sums(df, keys, levels, order, {name: F.lit(1)}, totals=True)


def hash_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Dense 1-based numbering of unique `key`s in the order of their md5: even buckets, any key type."""
    digest = F.md5(F.col(key).cast("string"))
    marked = df.withColumn("digest", digest).withColumn("digest_head", F.substring("digest", 1, 4))
    return running_rank(marked, [], ["digest_head"], ["digest", key], name).drop("digest")
