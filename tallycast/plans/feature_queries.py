"""Queries over the snapshot table: features, trends, leakage, split, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up
from tallycast.functions.timing import HOUR, days, from_micros, micros
from tallycast.operators import leakage, snapshots, trends
from tallycast.operators.live import time_fill
from tallycast.plans.oracle_views import r, with_views
from tallycast.plans.registry import query
from tallycast.session import cut
from tallycast.sources import views as V

INACTIVE_DAYS = 1
MIN_MOVE = 0.2


def newest_event(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").agg(F.max("ts").alias("now"))


def cap_time(spark: SparkSession, d: str) -> Column:
    """The reference point of the hard cap: three days before the newest event."""
    return (newest_event(spark, d).select(F.col("now") - days(3))).scalar()


def with_trends(spark: SparkSession, d: str) -> DataFrame:
    return trends.merge_trends(V.snapshots(spark, d), V.trends(spark, d))


def marked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.mark_removed(
        V.snapshots(spark, d), V.markets_unsplit(spark, d), cap_time(spark, d), INACTIVE_DAYS, MIN_MOVE
    )


def clean(spark: SparkSession, d: str) -> DataFrame:
    """Trends are attached after the leakage passes, to the rows that survive them."""
    kept = leakage.clean_snapshots(
        V.snapshots(spark, d), V.markets(spark, d), cap_time(spark, d), INACTIVE_DAYS, MIN_MOVE
    )
    return trends.merge_trends(kept, V.trends(spark, d))


def stored_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean table written once, for jobs that pass over it several times."""
    return cut(clean(spark, d))


@query("snapshot_features", with_views("SELECT * FROM snapshots", "snapshots"))
def snapshot_features(spark, d):
    return V.snapshots(spark, d)


@query("snapshot_raw", with_views("SELECT * FROM raw_snapshots", "raw_snapshots"))
def snapshot_raw(spark, d):
    return V.raw_snapshots(spark, d)


@query("clean_dataset", with_views("SELECT * FROM clean", "clean"))
def clean_dataset(spark, d):
    return clean(spark, d)


@query("trend_features", with_views("SELECT * FROM trends", "trends"))
def trend_features(spark, d):
    return V.trends(spark, d)


@query(
    "trend_keyword_mean",
    with_views(
        f"""SELECT category, week_start, {r('avg(v)', 2)} AS trend_value FROM (
              SELECT event_type AS category, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start, user_id % 5 AS k, {r('avg(value)', 4)} AS v
              FROM events GROUP BY ALL)
            WHERE week_start < (SELECT CAST(date_trunc('week', max(ts)) AS TIMESTAMP) FROM events) GROUP BY ALL"""),
)
def trend_keyword_mean(spark, d):
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    series = ["k0", "k1", "k2", "k3", "k4"]
    wide = (
        V.table(spark, d, "events")
        .groupBy(F.col("event_type").alias("category"), week.alias("week_start"))
        .agg(*[half_up(F.avg(F.when(F.col("user_id") % 5 == i, F.col("value"))), 4).alias(k) for i, k in enumerate(series)])
    )
    partial = F.col("week_start") == newest_event(spark, d).select(F.date_trunc("week", "now").cast("timestamp_ntz")).scalar()
    return trends.keyword_mean(wide.withColumn("is_partial", partial), series)


@query("c_asof_trends", with_views("SELECT * FROM with_trends", "with_trends"))
def c_asof_trends(spark, d):
    return with_trends(spark, d)


@query(
    "c_asof_prices",
    with_views(
        """SELECT v.event_id, c.price AS last_click_price FROM (SELECT * FROM events WHERE event_type = 'view') v
           ASOF LEFT JOIN (SELECT user_id, ts, max(price) AS price FROM (
             SELECT e.user_id, e.ts, p.price FROM events e JOIN prices p ON p.event_id = e.event_id WHERE e.event_type = 'click') GROUP BY ALL) c
           ON v.user_id = c.user_id AND v.ts >= c.ts""", "prices"),
)
def c_asof_prices(spark, d):
    ev = V.table(spark, d, "events")
    price = half_up(F.least(F.col("value"), F.lit(100.0)) / 100.0, 4)
    clicks = ev.filter("event_type = 'click'").groupBy("user_id", F.col("ts").alias("click_ts")).agg(F.max(price).alias("last_click_price"))
    views = ev.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return trends.asof_join_dense(views, clicks, "user_id", "ts", "click_ts", ["last_click_price"]).select(
        "event_id", "last_click_price")


@query(
    "q_leakage_counts",
    with_views("SELECT coalesce(removed_by, 'kept') AS removed_by, count(*) AS n, count(DISTINCT market_id) AS markets FROM marked GROUP BY 1", "marked"),
)
def q_leakage_counts(spark, d):
    return leakage.removal_counts(marked(spark, d))


@query(
    "b_settled_filter",
    with_views("SELECT split, count(*) AS n FROM snapshots WHERE NOT (price_at_snapshot >= 0.95 OR price_at_snapshot <= 0.05) GROUP BY split", "snapshots"),
)
def b_settled_filter(spark, d):
    return V.snapshots(spark, d).filter(~leakage.is_settled()).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c_closed_times",
    with_views("""SELECT s.market_id, s.snapshot_timestamp, m.closed_time FROM snapshots s
                  LEFT JOIN (SELECT * FROM markets WHERE closed_time IS NOT NULL) m ON m.market_id = s.market_id
                  WHERE m.closed_time IS NULL OR s.snapshot_timestamp <= m.closed_time""", "snapshots"),
)
def c_closed_times(spark, d):
    known = V.markets_unsplit(spark, d).filter("closed_time IS NOT NULL").select("market_id", "closed_time")
    rows = V.snapshots(spark, d).select("market_id", "snapshot_timestamp").join(known, "market_id", "left")
    return rows.filter(F.col("closed_time").isNull() | (F.col("snapshot_timestamp") <= F.col("closed_time")))


@query(
    "e_inactivity_cutoff",
    with_views(
        """SELECT market_id, least(coalesce(max(CASE WHEN moved THEN snapshot_timestamp END) + INTERVAL 1 DAY, (SELECT cap FROM as_of)), (SELECT cap FROM as_of)) AS inactive_after
           FROM (SELECT market_id, snapshot_timestamp, abs(price_at_snapshot - lag(price_at_snapshot) OVER (PARTITION BY market_id ORDER BY snapshot_timestamp)) > 0.2 AS moved
                 FROM snapshots) GROUP BY market_id""", "snapshots", "as_of"),
)
def e_inactivity_cutoff(spark, d):
    return leakage.inactivity_cutoffs(V.snapshots(spark, d), leakage.hard_cap(cap_time(spark, d)), INACTIVE_DAYS, MIN_MOVE)


@query("e_time_split", with_views("SELECT market_id, coalesce(closed_time, end_date) AS resolved_at, split FROM markets", "markets"))
def e_time_split(spark, d):
    return V.markets(spark, d).select("market_id", F.coalesce("closed_time", "end_date").alias("resolved_at"), "split")


@query(
    "d_split_cutoff",
    with_views("""SELECT max(closed_time) AS cutoff, count(*) FILTER (closed_time IS NULL) AS without_closed_time
                  FROM markets WHERE split = 'train'""", "markets"),
)
def d_split_cutoff(spark, d):
    return leakage.split_cutoff(V.markets(spark, d))


@query(
    "b_pre_cutoff",
    with_views("""SELECT CASE WHEN split = 'test' AND snapshot_timestamp < (SELECT max(closed_time) FROM markets WHERE split = 'train')
                  THEN 'test_pre_cutoff' ELSE split END AS label, count(*) AS n FROM snapshots GROUP BY 1""", "snapshots"),
)
def b_pre_cutoff(spark, d):
    cutoff = leakage.split_cutoff(V.markets(spark, d)).select("cutoff").scalar()
    return leakage.mark_pre_cutoff(V.snapshots(spark, d), cutoff).groupBy(F.col("split").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "m_holdout_split",
    with_views(
        """SELECT part, count(*) AS n, count(DISTINCT market_id) AS markets FROM (
             SELECT c.market_id, CASE WHEN k.pos <= floor(k.n * 0.8::DOUBLE) THEN 'fit'
                      WHEN c.snapshot_timestamp >= (SELECT max(resolved_at) FROM ranked WHERE pos <= floor(n * 0.8::DOUBLE)) THEN 'holdout' ELSE 'dropped' END AS part
             FROM train c JOIN ranked k ON k.market_id = c.market_id) GROUP BY part""", "clean",
        extra={"train": "SELECT * FROM clean WHERE split = 'train'",
               "ranked": """SELECT market_id, coalesce(closed_time, end_date) AS resolved_at,
                     row_number() OVER (ORDER BY coalesce(closed_time, end_date), md5(CAST(market_id AS VARCHAR))) AS pos, count(*) OVER () AS n
                   FROM markets WHERE market_id IN (SELECT market_id FROM train)"""}),
)
def m_holdout_split(spark, d):
    train = stored_clean(spark, d).filter("split = 'train'").select("market_id", "snapshot_timestamp")
    parts = leakage.holdout_split(train, V.markets_unsplit(spark, d), 0.2)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("market_id").alias("markets"))


@query("e_snapshot_grid", with_views("SELECT market_id, snapshot_timestamp FROM grid", "grid"))
def e_snapshot_grid(spark, d):
    grid = snapshots.snapshot_grid(V.markets_unsplit(spark, d))
    return grid.select("market_id", from_micros("snapshot_us").alias("snapshot_timestamp"))


@query(
    "e_point_in_time_price",
    with_views(
        f"""SELECT market_id, snapshot_timestamp, n_prices, price FROM (
              SELECT g.market_id, g.snapshot_timestamp, count(*) AS n_prices, {r('max_by(p.price, (p.ts, p.event_id))', 4)} AS price
              FROM grid g JOIN prices p ON p.market_id = g.market_id AND p.ts <= g.snapshot_timestamp GROUP BY 1, 2) WHERE n_prices >= 20""", "grid"),
)
def e_point_in_time_price(spark, d):
    f = snapshots.price_features(V.prices(spark, d), V.markets_unsplit(spark, d).select("market_id", "start_date", "end_date", "closed_time"), window_days=())
    return f.select("market_id", from_micros("snapshot_us").alias("snapshot_timestamp"), "n_prices", F.col("price_at_snapshot").alias("price"))


@query(
    "b_finish_counts",
    with_views(
        """SELECT count(*) FILTER (price_at_snapshot < 0 OR price_at_snapshot > 1) AS clipped,
                  count(*) FILTER (price_mean_7d IS NULL) AS filled_7d, count(*) FILTER (price_mean_14d IS NULL) AS filled_14d FROM raw_snapshots""",
        "raw_snapshots"),
)
def b_finish_counts(spark, d):
    return snapshots.finish_counts(V.raw_snapshots(spark, d))


GAP_SQL = """SELECT count(*) FILTER (gap IS NOT NULL AND gap <> {step}) AS bad_gaps, count(*) FILTER (gap IS NOT NULL) AS gaps FROM (
    SELECT epoch_us({ts}) - lag(epoch_us({ts})) OVER (PARTITION BY {key} ORDER BY {ts}) AS gap FROM {src})"""


def gap_counts(df: DataFrame, key: str, ts: str, step_us: int) -> DataFrame:
    gap = micros(ts) - F.lag(micros(ts)).over(W.partitionBy(key).orderBy(ts))
    return df.select(gap.alias("gap")).agg(
        F.count_if(F.col("gap") != step_us).alias("bad_gaps"), F.count("gap").alias("gaps"))


@query("e_snapshot_gaps", with_views(GAP_SQL.format(step=12 * HOUR, ts="snapshot_timestamp", key="market_id", src="clean"), "clean"))
def e_snapshot_gaps(spark, d):
    return gap_counts(clean(spark, d).select("market_id", "snapshot_timestamp"), "market_id", "snapshot_timestamp", 12 * HOUR)


@query("e_weekly_gaps", with_views(GAP_SQL.format(step=7 * 24 * HOUR, ts="week_start", key="category", src="trend_values"), "trend_values"))
def e_weekly_gaps(spark, d):
    return gap_counts(V.trend_values(spark, d), "category", "week_start", 7 * 24 * HOUR)


@query(
    "d_time_fill",
    with_views(
        f"""SELECT {', '.join(f'{r(f"quantile_cont({c}, 0.5)", 4)} AS {c}' for c in ('days_before_close', 'pct_lifetime_elapsed', 'duration_days'))}
            FROM clean WHERE split = 'train'""", "clean"),
)
def d_time_fill(spark, d):
    return time_fill(stored_clean(spark, d).filter("split = 'train'"))
