"""The first usable folder of a model's predictions, and why others are passed over."""

from __future__ import annotations

from tallycast.sources import tables as TB


def test_first_usable_source_wins(spark, tmp_path):
    def put(name, sql):
        spark.sql(sql).write.parquet(str(tmp_path / name))
        return TB.Source(str(tmp_path / name), ("prob", "p"))

    missing = TB.Source(str(tmp_path / "missing"), ("p",))
    bare = put("bare", "SELECT 1 AS k, timestamp'2024-01-01' AS snapshot_timestamp, 'v2' AS dataset_version")
    undated = put("undated", "SELECT 1 AS k, 0.5 AS p, 'v2' AS dataset_version")
    stale = put("stale", "SELECT 1 AS k, 0.5 AS p, timestamp'2024-01-01' AS snapshot_timestamp, explode(array('v1', 'v2')) AS dataset_version")
    unknown = put("unknown", "SELECT 1 AS k, 0.5 AS p, timestamp'2024-01-01' AS snapshot_timestamp")
    empty = put("empty", "SELECT 1 AS k, 0.5 AS p, timestamp'2024-01-01' AS snapshot_timestamp, 'v2' AS dataset_version LIMIT 0")
    good = put("good", "SELECT 1 AS k, 0.5 AS p, 0.25 AS prob, timestamp'2024-01-01' AS snapshot_timestamp, 'v2' AS dataset_version")
    rows, report = TB.predictions_in_order(spark, {
        "none": [missing], "bare": [missing, bare], "undated": [bare, undated], "stale": [undated, stale], "unknown": [unknown], "empty": [empty, missing],
        "good": [missing, bare, undated, stale, good, unknown]}, ["k"], "v2")
    assert {r.model: (r.source, r.prob_column, r.skipped) for r in report.collect()} == {
        "none": (None, None, "no prediction file found"), "bare": (None, None, "no probability column in bare"),
        "undated": (None, None, "undated has no snapshot_timestamp column"), "stale": (None, None, "stale was not trained on dataset v2"),
        "unknown": (None, None, "unknown was not trained on dataset v2"), "empty": (None, None, "empty was not trained on dataset v2"), "good": ("good", "prob", None)}
    assert [tuple(r) for r in rows.collect()] == [(1, "good", 0.25)]
    assert TB.predictions_in_order(spark, {"none": [missing]}, ["k"], "v2")[0] is None
