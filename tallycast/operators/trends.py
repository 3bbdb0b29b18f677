"""Weekly search-trend features and the backward as-of join onto snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up
from tallycast.functions.timing import DAY, days, div, micros

TREND_COLUMNS = ["trend_value", "trend_ma4", "trend_change_4w", "trend_spike", "has_trend_data"]


def keyword_mean(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Weekly value of a category: mean of its keyword series (missing ones left out), complete weeks only."""
    present = F.filter(F.array(*[F.col(k).cast("double") for k in keywords]), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0))
    return df.filter(~F.coalesce(F.col("is_partial"), F.lit(False))).select(
        "category", "week_start", half_up(mean, 2).alias("trend_value")
    )


def weekly_features(df: DataFrame, filler: str = "other") -> DataFrame:
    """Four-row mean, change against four rows earlier, spike flag; a filler category of zero rows.

    One row per category and week, so the windows are bounded by the number of weeks.
    """
    by_week = W.partitionBy("category").orderBy("week_start")
    value = F.col("trend_value")
    out = (
        df.withColumn("trend_ma4", half_up(F.avg(value).over(by_week.rowsBetween(-3, 0)), 2))
        .withColumn("trend_change_4w", F.coalesce(half_up(value - F.lag(value, 4).over(by_week), 2), F.lit(0.0)))
        .withColumn("trend_spike", (value > 1.5 * F.col("trend_ma4")).cast("int"))
        .withColumn("has_trend_data", F.lit(1))
        .select("category", "week_start", *TREND_COLUMNS)
    )
    lead = df.agg(F.min("category").alias("lead_category"))
    weeks = df.select("category", "week_start").filter(F.col("category") == lead.scalar()).select("week_start")
    zeros = weeks.select(
        F.lit(filler).alias("category"), "week_start",
        *[F.lit(0.0).alias(c) for c in TREND_COLUMNS[:3]], *[F.lit(0).alias(c) for c in TREND_COLUMNS[3:]],
    )
    return out.unionByName(zeros)


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], bucket_days: int = 7
) -> DataFrame:
    """For each left row the latest right row of the same key with right_ts <= left_ts; NULLs if none.

    Every right row is valid until its successor, the last one of a key to the end of all right rows. It is copied
    into each time bucket of that span, and left rows look up (key, bucket) in one join, so no key is gathered in one
    task and a left row meets only the right rows of its own bucket; rows later than all right rows look into the last
    bucket. Where the copies fit Spark's broadcast threshold nothing of the left side is shuffled, else it is once.
    (key, right_ts) must be unique. For a right side with few rows per key and bucket, such as a weekly
    grid; `asof_join_dense` takes any.
    """
    width = bucket_days * DAY
    rows = right.filter(F.col(right_ts).isNotNull()).select(F.col(key), micros(right_ts).alias("from_us"), F.struct(*values).alias("hit"))
    end = rows.agg(div(F.max("from_us"), width).alias("end"))
    spans = rows.withColumn("until_us", F.lead("from_us").over(W.partitionBy(key).orderBy("from_us")))
    last = F.when(F.col("until_us").isNull(), end.scalar()).otherwise(div(F.col("until_us") - 1, width))
    c = spans.withColumn("bucket", F.explode(F.sequence(div(F.col("from_us"), width), last))).alias("c")
    r = left.withColumn("at_us", micros(left_ts)).withColumn("bucket", F.least(div(F.col("at_us"), width), end.scalar())).alias("r")
    matched = r.join(
        c,
        (F.col(f"r.{key}") == F.col(f"c.{key}"))
        & (F.col("r.bucket") == F.col("c.bucket"))
        & (F.col("c.from_us") <= F.col("r.at_us"))
        & (F.col("c.until_us").isNull() | (F.col("r.at_us") < F.col("c.until_us"))),
        "left",
    )
    return matched.select(*[F.col(f"r.{c}") for c in left.columns], *[F.col("c.hit").getField(v).alias(v) for v in values])


def asof_join_dense(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], bucket_days: int = 1
) -> DataFrame:
    """The same result for a right side of any density, in linear work per (key, bucket).

    Both sides are ordered together inside a bucket; a left row without an earlier right row there takes
    the last right row of an earlier bucket, found among per-bucket maxima.
    """
    width = bucket_days * DAY
    payload = F.struct(*values)
    a = left.select(key, micros(left_ts).alias("at_us"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"))
    b = right.select(key, micros(right_ts).alias("at_us"), F.lit(0).alias("side"), payload.alias("hit"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("bucket", div(F.col("at_us"), width))
    inside = W.partitionBy(key, "bucket").orderBy("at_us", "side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("near", F.last("hit", ignorenulls=True).over(inside)).filter("side = 1")
    newest = both.groupBy(key, "bucket").agg(F.max_by("hit", F.when(F.col("side") == 0, F.col("at_us"))).alias("newest"))
    earlier = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = newest.select(key, "bucket", F.last("newest", ignorenulls=True).over(earlier).alias("carried"))
    best = F.coalesce("near", "carried")
    return found.join(carried, [key, "bucket"], "left").select("row.*", *[best.getField(v).alias(v) for v in values])


def merge_trends(snapshots: DataFrame, trends: DataFrame) -> DataFrame:
    """Attach the latest completed week of the snapshot's category; a week is usable seven days after it starts."""
    ready = trends.withColumn("available_at", F.col("week_start") + days(7))
    merged = asof_join(snapshots, ready, "category", "snapshot_timestamp", "available_at", TREND_COLUMNS)
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in TREND_COLUMNS[:3]}
    filled |= {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in TREND_COLUMNS[3:]}
    return merged.withColumns(filled)
