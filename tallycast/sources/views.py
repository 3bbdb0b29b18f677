"""Domain tables derived from the generic test tables: price histories, market metadata, scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up
from tallycast.functions.timing import days, micros, whole_days
from tallycast.operators.leakage import time_split
from tallycast.operators.snapshots import build_snapshots, finish_features
from tallycast.operators.trends import weekly_features

TRAIN_FRACTION = 0.8
SCORE_COLUMNS = {"market": "price_at_snapshot", "model_a": "p_model_a", "model_b": "p_model_b"}
#: Scored rows of a task.
TASK_ROWS = 500_000
ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "snapshot_timestamp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("market_id"), "event_id", "ts",
        half_up(F.least(F.col("value"), F.lit(100.0)) / 100.0, 4).alias("price"),
    )


def markets_unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.struct("ts", "event_id")
    price = half_up(F.least(F.col("value"), F.lit(100.0)) / 100.0, 4)
    m = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("market_id"))
        .agg(
            F.min("ts").alias("start_date"),
            F.max_by(price, when).alias("yes_final_price"),
            F.min_by("event_type", when).alias("first_type"),
            half_up(F.sum("value"), 2).alias("total_volume"),
        )
    )
    mid = F.col("market_id")
    end = F.col("start_date") + days((20 + mid % 12).cast("int"))
    m = m.withColumn("end_date", end)
    return m.select(
        "market_id",
        F.concat(F.lit("tok-"), mid.cast("string")).alias("clob_token_id"),
        F.concat(F.lit("Will the "), F.col("first_type"), F.lit(" count pass "), mid.cast("string"), F.lit("?")).alias(
            "question"
        ),
        F.when(mid % 10 == 9, "other").otherwise(F.col("first_type")).alias("category"),
        "start_date", "end_date",
        whole_days("start_date", "end_date").alias("duration_days"),
        "total_volume", "yes_final_price",
        (F.col("yes_final_price") >= 0.5).cast("int").alias("outcome"),
        F.when(mid % 5 != 0, F.col("end_date") - days((mid % 4).cast("int"))).alias("closed_time"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_split(markets_unsplit(spark, sf_dir), TRAIN_FRACTION)


def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = markets_unsplit(spark, sf_dir)
    split = time_split(plain, TRAIN_FRACTION).select("market_id", "split")
    return build_snapshots(prices(spark, sf_dir), plain).join(split, "market_id")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish_features(raw_snapshots(spark, sf_dir))


def trend_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("category"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week_start"))
        .agg(half_up(F.avg("value"), 2).alias("trend_value"))
    )


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_features(trend_values(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: a market price and two model probabilities per row of `lineitem`."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # orders meet their customers first, so the many lines are dealt once, by the key that later steps group by, and
    # to as many tasks as there are lines for, so what a task holds does not grow with the table
    parts = -(-line.count() // TASK_ROWS)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        line = line.repartition(parts, "l_orderkey")
    bought = orders.join(customer, orders.o_custkey == customer.c_custkey)
    rows = line.join(bought, line.l_orderkey == bought.o_orderkey)

    def clip(c):
        return F.least(F.greatest(c, F.lit(0.001)), F.lit(0.999))

    return rows.select(
        F.col("l_orderkey").alias("market_id"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_shipdate").alias("snapshot_timestamp"),
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", micros("l_shipdate")).alias("row_key"),
        (F.col("l_returnflag") == "R").cast("int").alias("outcome"),
        half_up(0.05 + F.col("l_discount") * 9, 4).alias("price_at_snapshot"),
        clip(half_up(F.col("l_discount") * 6 + F.col("l_quantity") / 125, 4)).alias("p_model_a"),
        clip(half_up((F.col("l_tax") * 10 + F.col("l_quantity") / 50) / 2, 4)).alias("p_model_b"),
        F.col("c_mktsegment").alias("category"),
        (1 + F.col("l_orderkey") % 500).alias("duration_days"),
        (F.col("l_orderkey") % 120 + F.col("l_linenumber") / 10.0).alias("days_before_close"),
        ((F.col("l_partkey") % 1000) / 1000.0).alias("pct_lifetime_elapsed"),
        F.col("o_totalprice").alias("total_volume"),
    )


def long_scores(df: DataFrame, keep: list[str], columns: dict[str, str] = SCORE_COLUMNS) -> DataFrame:
    """One row per (row, model) with the probability in `p`."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in columns.items()])
    return df.select(*keep, F.inline(pairs))
