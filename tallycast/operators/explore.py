"""Descriptive tables: distributions, nulls, duplicates, correlations, model comparisons."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles, half_up
from tallycast.functions.running import join_null_safe
from tallycast.operators.slices import equal_width


def long_columns(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per (row, column name) with the value as double; no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def describe(df: DataFrame, columns: list[str], keys: list[str] = (), probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, min, exact quantiles and max per column (and key)."""
    long = long_columns(df, columns, list(keys))
    by = [*keys, "column"]
    base = long.groupBy(*by).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = exact_percentiles(long, by, "value", list(probs))
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{int(p * 100):02d}") for p in probs])
    return join_null_safe(base, wide, by, "left")


def value_counts(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """Rows per value and their share of the (keyed) total."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
        return join_null_safe(counts, totals, list(keys)).withColumn("share", F.col("n") / F.col("total")).drop("total")
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n").alias("total")).scalar())


def range_counts(df: DataFrame, column: str, ranges: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Rows per [lower, upper) range; every range is listed, one pass."""
    c = F.col(column)
    tests = [F.count_if((c >= lo if lo is not None else F.lit(True)) & (c < hi if hi is not None else F.lit(True))).alias(n)
             for n, lo, hi in ranges]
    one = df.agg(*tests)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("range"), F.col(f"`{n}`").alias("n")) for n, _, _ in ranges])))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.try_divide(F.col(f"n_{c}"), F.col("rows")).alias("share"))
        for c in columns])))


def any_null(df: DataFrame, groups: dict[str, list[str]], market: str = "market_id") -> DataFrame:
    """Rows and markets with any NULL in a group of columns."""
    tests = {}
    for name, cols in groups.items():
        bad = F.lit(False)
        for c in cols:
            bad = bad | F.col(c).isNull()
        tests[name] = bad
    pairs = F.array(*[F.struct(F.lit(n).alias("feature_group"), t.alias("bad")) for n, t in tests.items()])
    long = df.select(market, F.inline(pairs))
    return long.groupBy("feature_group").agg(
        F.count_if("bad").alias("rows"), F.countDistinct(F.when(F.col("bad"), F.col(market))).alias("markets"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """The rows whose id's digest lies in the lowest `fraction` of its range."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.filter(head < math.ceil(fraction * 2**32))


def split_overlap(df: DataFrame, market: str = "market_id") -> DataFrame:
    """Markets whose rows lie in both train and test."""
    s = F.col("split")
    per = df.groupBy(market).agg(F.bool_or(s == "train").alias("in_train"), F.bool_or(s != "train").alias("in_test"))
    return per.filter("in_train AND in_test").select(market)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation per pair, all in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def target_correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    one = df.agg(*[F.corr(c, target).alias(f"c{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("r")) for i, c in enumerate(columns)])))


def histogram(df: DataFrame, value: Column, bins: int, keys: list[str] = (), lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram with density; the range is the observed one unless given."""
    rows = df.select(*keys, value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    low = F.lit(lo) if lo is not None else ends.select("lo").scalar()
    high = F.lit(hi) if hi is not None else ends.select("hi").scalar()
    placed = rows.withColumn("lo", low).withColumn("hi", high)
    counts = placed.withColumn("bin", equal_width(F.col("v"), F.col("lo"), F.col("hi"), bins)).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
        counts = join_null_safe(counts, totals, list(keys))
    else:
        counts = counts.withColumn("total", counts.agg(F.sum("n").alias("t")).scalar())
    return counts.select(*keys, "bin", "n", (F.col("lo") + F.col("bin") * width).alias("edge"),
                         F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def null_share_by_decile(df: DataFrame, position: str, column: str, bins: int = 10) -> DataFrame:
    """Share of NULLs per right-closed equal-width bin of the observed range of `position`."""
    rows = df.select(F.col(position).alias("x"), F.col(column).isNull().cast("int").alias("is_null")).filter(F.col("x").isNotNull())
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = rows.withColumn("lo", ends.select("lo").scalar()).withColumn("hi", ends.select("hi").scalar())
    width = (F.col("hi") - F.col("lo")) / bins
    above = sum((F.when(F.col("x") > F.col("lo") + k * width, 1).otherwise(0) for k in range(1, bins)), F.lit(0))
    return placed.groupBy(above.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("is_null").alias("null_share"))


def concordance(df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome") -> DataFrame:
    """Share of a market's rows on the right side of one half."""
    right = ((F.col(p) > 0.5) == (F.col(y) == 1)).cast("int")
    return df.groupBy(*keys, "market_id").agg(F.avg(right).alias("concordance"), F.count(F.lit(1)).alias("n"))


def first_correct_cross(df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome", at: str = "pct_lifetime_elapsed") -> DataFrame:
    """Earliest lifetime share at which the score is on the right side; NULL if never."""
    right = (F.col(p) > 0.5) == (F.col(y) == 1)
    return df.groupBy(*keys, "market_id").agg(F.min(F.when(right, F.col(at))).alias("first_cross"))


def error_counts(p: str = "p", y: str = "outcome", market: str = "price_at_snapshot") -> list[Column]:
    """Directional and over-confident errors, and how many of the latter the market price shared."""
    s, yes = F.col(p), F.col(y) == 1
    wrong = (s > 0.5) != yes
    sure = ((s > 0.8) & ~yes) | ((s < 0.2) & yes)
    market_wrong = (F.col(market) > 0.5) != yes
    return [
        F.count(F.lit(1)).alias("n"), F.avg(wrong.cast("int")).alias("wrong_rate"),
        F.count_if((s > 0.8) & ~yes).alias("sure_yes_wrong"), F.count_if((s < 0.2) & yes).alias("sure_no_wrong"),
        F.avg(sure.cast("int")).alias("sure_wrong_rate"),
        F.try_divide(F.count_if(sure & market_wrong), F.count_if(sure)).alias("shared_with_market"),
    ]


def error_rates(df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome", market: str = "price_at_snapshot") -> DataFrame:
    return df.groupBy(*keys).agg(*error_counts(p, y, market))


def error_report(df: DataFrame, key: str, dimensions: list[str], p: str = "p", y: str = "outcome", market: str = "price_at_snapshot") -> DataFrame:
    """Errors of each `key` overall and by each dimension, as (key, dimension, value, ...) from one pass: the
    grouping sets are expanded in the scan and summed before the shuffle. NULL is a value of its own."""
    sets = [[key], *([key, d] for d in dimensions)]
    found = df.groupingSets([[F.col(c) for c in s] for s in sets], key, *dimensions).agg(
        *error_counts(p, y, market), *[F.grouping(d).alias(f"without_{d}") for d in dimensions])
    dimension, value = F.lit("overall"), F.lit(None).cast("string")
    for d in dimensions:
        here = F.col(f"without_{d}") == 0
        dimension, value = F.when(here, d).otherwise(dimension), F.when(here, F.col(d).cast("string")).otherwise(value)
    return found.select(key, dimension.alias("dimension"), value.alias("value"), "n", "wrong_rate", "sure_yes_wrong", "sure_no_wrong",
                        "sure_wrong_rate", "shared_with_market")


def disagreements(df: DataFrame, p: str, threshold: float = 0.5, price: str = "price_at_snapshot", y: str = "outcome",
                  order: tuple[str, ...] = ("snapshot_timestamp",)) -> DataFrame:
    """Per market: mean model and market probability (rounded, so that summation order cannot decide a
    tie at the threshold), and which of the two was right."""
    per = df.groupBy("market_id").agg(
        F.min_by(F.struct(F.col(y).alias("outcome"), "category", "total_volume"), F.struct(*order)).alias("m"),
        half_up(F.avg(p), 9).alias("model_prob"), half_up(F.avg(price), 9).alias("market_prob"),
    ).select("market_id", "m.*", "model_prob", "market_prob")
    yes = F.col("outcome") == 1
    model_right, market_right = (F.col("model_prob") >= threshold) == yes, (F.col("market_prob") >= 0.5) == yes
    kind = F.when(model_right & ~market_right, "model_only_right").when(~model_right & market_right, "market_only_right").when(
        model_right, "both_right").otherwise("both_wrong")
    return per.withColumn("kind", kind)


def top_per_class(df: DataFrame, classes: list[str], n: int, order: list[Column], column: str = "kind") -> DataFrame:
    """Top n rows of each class in one pass. Spark keeps n rows a class in each task before it shuffles (a group
    limit below the window), so a class of any size brings few rows together."""
    place = F.row_number().over(W.partitionBy(column).orderBy(*order))
    return df.filter(F.col(column).isin(classes)).withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def prediction_class(p: str = "p", y: str = "outcome") -> Column:
    """well (off by less than 0.2), poor_yes, poor_no, or middling."""
    s, yes = F.col(p), F.col(y) == 1
    return (
        F.when(F.abs(s - F.col(y)) < 0.2, "well").when((s < 0.35) & yes, "poor_yes").when((s > 0.65) & ~yes, "poor_no").otherwise("middling")
    )


def spread(columns: list[str]) -> Column:
    """Largest minus smallest of the scores present."""
    return F.greatest(*[F.col(c) for c in columns]) - F.least(*[F.col(c) for c in columns])


def mean_of(columns: list[str]) -> Column:
    """Mean of the scores present."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, present)
