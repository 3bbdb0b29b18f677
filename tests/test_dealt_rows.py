"""Scored rows are dealt once, by market, to tasks of a bounded size; nearest rows are found in one pass over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.operators import backtest as B
from tallycast.sources import views as V


def test_tasks_of_scored_rows_follow_the_table(spark, monkeypatch):
    monkeypatch.setattr(V, "TASK_ROWS", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large tables are joined by a shuffle
    try:
        rows = V.scored(spark, "/root/testdata/sf0.001")
        want = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
        assert rows.rdd.getNumPartitions() == want
        assert rows.groupBy("market_id").count().rdd.getNumPartitions() == want  # no further shuffle
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nearest_rows_do_not_copy_rows_per_target(spark):
    rows = spark.createDataFrame([(m, k / 10.0, f"r{k}") for m in (1, 2, None) for k in range(m or 3, 9)], "market_id int, at double, row_key string")
    got = B.nearest_rows(rows, [0.14, 0.56, 5.0], F.col("at"), ["at", "row_key"], ["row_key"])
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    found = {(r.market_id, r.horizon): (r.row_key, round(r.distance, 6)) for r in got.collect()}
    assert len(found) == 9 and found[1, 0.56] == ("r6", 0.04) and found[None, 0.14] == ("r3", 0.16)
    assert found[1, 0.14] == ("r1", 0.04) and found[2, 5.0] == ("r8", 4.2)
    assert got.columns == ["market_id", "horizon", "row_key", "position", "distance"]
