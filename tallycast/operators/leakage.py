"""Leakage removal and the split by resolution time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.running import running_rank
from tallycast.functions.timing import DAY, SECOND, days, div, micros

SETTLED_HIGH = 0.95
SETTLED_LOW = 0.05
PASSES = ["closed_time", "settled_price", "inactivity", "hard_cap"]


def is_settled(price: Column | str = "price_at_snapshot") -> Column:
    price = F.col(price) if isinstance(price, str) else price
    return (price >= SETTLED_HIGH) | (price <= SETTLED_LOW)


def hard_cap(as_of: Column) -> Column:
    """Midnight after `as_of`."""
    return F.date_trunc("day", as_of + days(1)).cast("timestamp_ntz")


def inactivity_cutoffs(rows: DataFrame, cap: Column, allowance_days: int = 14, min_move: float = 0.001) -> DataFrame:
    """Last snapshot whose price moved, plus the allowance, at most `cap`; markets without a move get `cap`.

    The window runs over a market's grid rows, bounded by its lifetime.
    """
    by_time = W.partitionBy("market_id").orderBy("snapshot_timestamp")
    move = F.abs(F.col("price_at_snapshot") - F.lag("price_at_snapshot").over(by_time))
    return (
        rows.withColumn("moved_at", F.when(move > min_move, F.col("snapshot_timestamp")))
        .groupBy("market_id")
        .agg(F.max("moved_at").alias("moved_at"))
        .select("market_id", F.least(F.coalesce(F.col("moved_at") + days(allowance_days), cap), cap).alias("inactive_after"))
    )


def mark_removed(
    snapshots: DataFrame, closed_times: DataFrame, as_of: Column, allowance_days: int = 14, min_move: float = 0.001
) -> DataFrame:
    """Adds `removed_by`: the first pass that drops the row (NULL = kept), and `closed_time`.

    The inactivity rule looks at unsettled rows only: each is compared with the unsettled row before it.
    That is a window over the market's grid rows, bounded by its lifetime, so all passes share one scan.
    """
    cap = hard_cap(as_of)
    known = closed_times.filter(F.col("closed_time").isNotNull()).select("market_id", "closed_time")
    market = W.partitionBy("market_id")
    earlier = market.orderBy("snapshot_timestamp").rowsBetween(W.unboundedPreceding, -1)
    ts, closed, price = F.col("snapshot_timestamp"), F.col("closed_time"), F.col("price_at_snapshot")
    last_open_price = F.last(F.when(~is_settled(), price), ignorenulls=True).over(earlier)
    moved = ~is_settled() & (F.abs(price - last_open_price) > min_move)
    joined = (
        snapshots.join(known, "market_id", "left")
        .withColumn("moved_at", F.when(moved, ts))
        .withColumn("last_move", F.max("moved_at").over(market))
    )
    inactive_after = F.least(F.coalesce(F.col("last_move") + days(allowance_days), cap), cap)
    reason = (
        F.when(ts > closed, PASSES[0])
        .when(is_settled(), PASSES[1])
        .when(closed.isNull() & (ts > inactive_after), PASSES[2])
        .when(ts > cap, PASSES[3])
    )
    return joined.withColumn("removed_by", reason).drop("moved_at", "last_move")


def removal_counts(marked: DataFrame) -> DataFrame:
    """Rows per pass, kept rows under `kept`."""
    return marked.groupBy(F.coalesce("removed_by", F.lit("kept")).alias("removed_by")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("market_id").alias("markets")
    )


def split_cutoff(markets: DataFrame) -> DataFrame:
    """One row: latest closing time among train markets and how many of them have none."""
    return markets.filter(F.col("split") == "train").agg(
        F.max("closed_time").alias("cutoff"), F.count_if(F.col("closed_time").isNull()).alias("without_closed_time")
    )


def mark_pre_cutoff(df: DataFrame, cutoff: Column) -> DataFrame:
    early = (F.col("split") == "test") & (F.col("snapshot_timestamp") < cutoff)
    return df.withColumn("split", F.when(early, "test_pre_cutoff").otherwise(F.col("split")))


def clean_snapshots(
    snapshots: DataFrame, markets: DataFrame, as_of: Column, allowance_days: int = 14, min_move: float = 0.001
) -> DataFrame:
    """All four passes, then the relabelling of test rows older than the cutoff."""
    marked = mark_removed(snapshots, markets.select("market_id", "closed_time"), as_of, allowance_days, min_move)
    kept = marked.filter(F.col("removed_by").isNull()).drop("removed_by", "closed_time")
    return mark_pre_cutoff(kept, split_cutoff(markets).select("cutoff").scalar())


def resolution_rank(markets: DataFrame) -> DataFrame:
    """Markets numbered by resolution time (closing time, else scheduled end), ties by md5 of the id.

    Many markets resolve at the same instant, so the finest level splits an instant by digest.
    """
    digest = F.md5(F.col("market_id").cast("string"))
    marked = (
        markets.withColumn("resolved_at", F.coalesce("closed_time", "end_date"))
        .withColumn("digest", digest)
        .withColumn("lvl_day", div(micros("resolved_at"), DAY))
        .withColumn("lvl_second", div(micros("resolved_at"), SECOND))
        .withColumn("lvl_tie", F.struct(micros("resolved_at").alias("us"), F.substring("digest", 1, 4).alias("head")))
    )
    return running_rank(marked, [], ["lvl_day", "lvl_second", "lvl_tie"], ["digest", "market_id"]).drop("digest")


def time_split(markets: DataFrame, train_fraction: float = 0.8) -> DataFrame:
    """First int(n * fraction) markets by resolution time are train, the rest test. A market without closing and end
    time has no place in that order and is an error."""
    timed = F.coalesce("closed_time", "end_date").isNotNull()
    missing = F.raise_error(F.concat(F.lit("market without closing and end time: "), F.coalesce(F.col("market_id").cast("string"), F.lit("NULL"))))
    ranked = resolution_rank(markets.withColumn("end_date", F.when(timed, F.col("end_date")).otherwise(missing.cast(markets.schema["end_date"].dataType))))
    is_train = F.col("rank") <= F.floor(F.col("tot_rank") * train_fraction)
    return ranked.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("rank", "tot_rank", "resolved_at")


def holdout_split(train: DataFrame, markets: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Adds `part`: fit, holdout, or dropped (holdout rows older than the last fit resolution)."""
    ids = train.select("market_id").distinct()
    ranked = resolution_rank(markets.join(ids, "market_id", "left_semi")).select(
        "market_id", "resolved_at", (F.col("rank") <= F.floor(F.col("tot_rank") * (1 - fraction))).alias("in_fit")
    )
    cutoff = ranked.filter("in_fit").agg(F.max("resolved_at").alias("cutoff"))
    part = (
        F.when(F.col("in_fit"), "fit")
        .when(F.col("snapshot_timestamp") >= cutoff.scalar(), "holdout")
        .otherwise("dropped")
    )
    return train.join(ranked.select("market_id", "in_fit"), "market_id").withColumn("part", part).drop("in_fit")
