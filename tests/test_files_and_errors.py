"""Checksums in pieces, versions per file, error reports in one pass, edges of the time left, one join as of a time."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tallycast.operators import explore as X
from tallycast.operators import slices as S
from tallycast.operators import trends as T
from tallycast.sources import manifest as MF
from tallycast.sources import tables as TB


def test_checksums_and_rows_of_files_with_odd_names(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b%c+d"
    spark.range(10).coalesce(1).write.parquet(str(folder / "x"))
    spark.range(7).select(F.col("id").cast("string").alias("name")).coalesce(1).write.parquet(str(folder / "y"))
    monkeypatch.setattr(MF, "PIECE", 100)
    files = MF.file_checksums(spark, str(folder)).filter("file LIKE '%.parquet'")
    got = files.join(MF.file_rows(spark, str(folder)), "path", "left").collect()
    want = {p.name: p.read_bytes() for p in folder.rglob("*.parquet")}
    assert {(r.file, r.bytes, r.sha256) for r in got} == {(n, len(b), hashlib.sha256(b).hexdigest()) for n, b in want.items()}
    assert sorted(r["rows"] for r in got) == [7, 10]
    assert "content" not in files.schema.names


def test_versions_of_files(spark, tmp_path):
    def put(name, *rows):
        spark.createDataFrame(list(rows), "row_key long, dataset_version string").coalesce(1).write.parquet(str(tmp_path / name))

    put("one", (1, "v1"), (2, "v1"))
    put("two", (1, "v1"), (2, "v2"))
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "none"))
    rows = {r.file.split("/")[-2]: (r.versions, r.version) for r in TB.file_versions(spark, f"{tmp_path}/*").collect()}
    assert rows == {"one": (1, "v1"), "two": (2, None), "none": (0, None)}


def test_error_report_has_the_rates_of_each_dimension(spark):
    rows = [("m", c, q, p, y, x) for c in ("a", None) for q, p, y, x in (("q1", 0.9, 0, 0.7), ("q1", 0.1, 1, 0.9), ("q2", 0.6, 1, 0.4), (None, 0.5, 0, 0.5))]
    df = spark.createDataFrame(rows, "model string, category string, quarter string, p double, outcome int, price_at_snapshot double")
    got = {(r.dimension, r.value): tuple(r)[3:] for r in X.error_report(df, "model", ["category", "quarter"]).collect()}
    assert len(got) == 1 + 2 + 3
    for key, part in {("overall", None): df, ("category", None): df.filter("category IS NULL"), ("quarter", "q1"): df.filter("quarter = 'q1'")}.items():
        assert got[key] == tuple(X.error_rates(part, ["model"]).first())[1:]


def test_edges_of_the_time_left(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 14, 14.5, 30, 30.5, 60, 61, 9999, 10000)], "d double")
    rows = [tuple(r) for r in df.select(S.left_open("d", S.STAGES_LEFT), S.left_open("d", S.DAYS_LEFT)).collect()]
    assert [a for a, _ in rows] == ["near"] * 4 + ["mid"] * 2 + ["far"] * 3
    assert [b for _, b in rows] == [None, None, "14-30d", "14-30d", "30-60d", "30-60d", "60-90d", ">365d", None]


def test_join_as_of_a_time_is_one_join(spark, t0):
    import datetime as dt

    at = lambda h: t0 + dt.timedelta(hours=h)
    schema = "k string, ts timestamp_ntz"
    left = spark.createDataFrame([("a", at(h)) for h in (-1, 0, 5, 400, 90_000)] + [("b", at(399)), ("c", at(1)), (None, at(1)), ("a", None)], schema)
    right = spark.createDataFrame([("a", at(0), 1), ("a", at(300), 2), ("b", at(1), 3), ("z", at(9000), 4), ("b", None, 5)], schema.replace("ts", "rts") + ", v int")
    out = T.asof_join(left, right, "k", "ts", "rts", ["v"])
    assert sorted(((r.k, r.ts), r.v) for r in out.filter("k IS NOT NULL AND ts IS NOT NULL").collect()) == [
        (("a", at(-1)), None), (("a", at(0)), 1), (("a", at(5)), 1), (("a", at(400)), 2), (("a", at(90_000)), 2), (("b", at(399)), 3), (("c", at(1)), None)]
    assert out.count() == 9 and T.asof_join(left, right.limit(0), "k", "ts", "rts", ["v"]).filter("v IS NULL").count() == 9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
