"""Fits and scoring get their rows in tasks by number of rows, not by bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.operators import modeling as ML
from tallycast.session import cut


def rows(spark, n=9000):
    k = F.col("id")
    return cut(spark.range(n).coalesce(1).select(
        (k % 300).alias("market_id"), F.when(k % 2 == 0, "a").when(k % 3 == 0, "b").alias("category"), ((k * 37) % 101 / 101.0).alias("price_at_snapshot"),
        F.when(k % 5 > 0, 1).otherwise(0).alias("outcome"), F.lit(1.0).alias("weight")).fillna("other", ["category"]))


def test_rows_are_dealt_by_number_and_stay(spark, monkeypatch):
    df = rows(spark)
    assert df.rdd.getNumPartitions() == 1 and ML.dealt(df).rdd.getNumPartitions() == 4
    monkeypatch.setattr(ML, "TASK_ROWS", 1000)
    out = ML.dealt(df)
    assert out.rdd.getNumPartitions() == 9 and out.columns == df.columns
    assert out.exceptAll(df).isEmpty() and df.exceptAll(out).isEmpty()
    assert ML.dealt(df.limit(0)).isEmpty()


def test_order_in_tasks_follows_from_the_rows(spark):
    df = rows(spark)
    parts = lambda x: x.rdd.glom().map(list).collect()
    assert parts(ML.dealt(df)) == parts(ML.dealt(df.repartition(5, "price_at_snapshot")))


def test_a_fit_is_dealt(spark, monkeypatch):
    seen = []
    plain = ML.dealt
    monkeypatch.setattr(ML, "dealt", lambda df: seen.append(df.count()) or plain(df))
    df = rows(spark)
    model = ML.fit_forest(ML.PRICE_ONLY, 3)(df, {"max_depth": 3, "min_samples_leaf": 5})
    assert ML.scored(model, df).count() == 9000 and seen == [9000, 9000]
