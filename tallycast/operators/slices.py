"""Bucket definitions and metrics by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles
from tallycast.functions.running import join_null_safe
from tallycast.operators.metrics import auc

# Fixed values: (label, lower, upper)
THIRDS = [("far", 0.0, 1 / 3), ("mid", 1 / 3, 2 / 3), ("near", 2 / 3, 1.01)]
DURATION = [("<=90d", 0, 90), ("91-180d", 91, 180), ("181-365d", 181, 365), (">365d", 366, 10**6)]
DURATION_WIDE = [("<=90d", 0, 90), ("91-365d", 91, 365), (">365d", 366, 10**6)]
TIME_LEFT = [("<1d", 0, 1), ("1-7d", 1, 7), ("7-14d", 7, 14), ("14-30d", 14, 30), (">=30d", 30, 10**6)]

# (label, above, up to): days before close by stage, and in the wider view from a fortnight on
STAGES_LEFT = [("near", -1e9, 30), ("mid", 30, 60), ("far", 60, 1e9)]
DAYS_LEFT = [("14-30d", 14, 30), ("30-60d", 30, 60), ("60-90d", 60, 90), ("90-180d", 90, 180), ("180-365d", 180, 365), (">365d", 365, 9999)]


def left_open(c: str, buckets) -> Column:
    """Label of the bucket with lower < value <= upper."""
    out = F.lit(None).cast("string")
    for label, lo, hi in reversed(buckets):
        out = F.when((F.col(c) > lo) & (F.col(c) <= hi), label).otherwise(out)
    return out


def half_open(c: str, buckets) -> Column:
    """Label of the bucket with lower <= value < upper."""
    out = F.lit(None).cast("string")
    for label, lo, hi in reversed(buckets):
        out = F.when((F.col(c) >= lo) & (F.col(c) < hi), label).otherwise(out)
    return out


def closed(c: str, buckets) -> Column:
    """Label of the bucket with lower <= value <= upper (whole-number columns)."""
    out = F.lit(None).cast("string")
    for label, lo, hi in reversed(buckets):
        out = F.when((F.col(c) >= lo) & (F.col(c) <= hi), label).otherwise(out)
    return out


def rank_fraction(df: DataFrame, order: list[str], name: str = "rank_pct") -> DataFrame:
    """(rank - 1) / rows of the market. Rows that are dealt by market already, as scored ones are, stay where they are:
    a task sorts its own rows and counts on, and what it can't hold goes to its disk."""
    market = W.partitionBy("market_id")
    pos = F.row_number().over(market.orderBy(*order))
    return df.withColumn(name, (pos - 1) / F.count(F.lit(1)).over(market))


def auc_by(df: DataFrame, keys: list[str], min_rows: int = 0, p: str = "p", y: str = "outcome") -> DataFrame:
    """Rows, markets and AUC per slice and model; AUC is NULL with one class."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("market_id").alias("markets"))
    return join_null_safe(sizes.filter(F.col("n") >= min_rows), auc(df, keys, p, y), keys)


def equal_width(c: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of n equal bins over [lo, hi]; the upper edge belongs to the last bin."""
    raw = F.floor((c - lo) / ((hi - lo) / n))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))


def quantile_bins(df: DataFrame, col: str, n: int, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins with repeated edges merged, numbered from 1. The edges are one row of
    at most n + 1 numbers."""
    edges = exact_percentiles(df, [], col, [k / n for k in range(n + 1)])
    sorted_edges = edges.agg(F.sort_array(F.collect_set("value")).alias("edges"))
    rows = df.filter(F.col(col).isNotNull()).withColumn("edges", sorted_edges.scalar())
    below = F.size(F.filter("edges", lambda e: e < F.col(col)))
    return rows.withColumn(name, F.greatest(below, F.lit(1))).drop("edges")
