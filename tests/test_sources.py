"""Catalogue files, evidence files, keyed tables, manifests."""

from __future__ import annotations

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tallycast.sources import catalogue as C
from tallycast.sources import manifest as MF
from tallycast.sources import tables as TB

DAY = dt.timedelta(days=1)
GOOD = {"outcomes": '["Yes","No"]', "outcomePrices": '["0.97","0.03"]', "clobTokenIds": '["t1","t2"]', "createdAt": "2024-01-01T00:00:00.123Z",
        "startDate": "2024-01-02T00:00:00Z", "endDate": "2024-03-01T00:00:00Z", "volumeNum": 5000, "closed": True, "slug": "a-b",
        "events": [{"slug": "ev"}]}
CASES = {
    "yes": {}, "no": {"outcomePrices": '["0.05","0.95"]'}, "real lists": {"outcomes": ["Yes", "No"], "outcomePrices": ["1", "0"], "clobTokenIds": ["t"]},
    "not_binary": {"outcomes": '["A","B","C"]'}, "bad json": {"outcomes": "oops"}, "bad_dates": {"endDate": "later"},
    "negative_duration": {"endDate": "2023-12-01T00:00:00Z"}, "too_short": {"endDate": "2024-01-20T00:00:00Z"},
    "no_outcome_field": {"outcomePrices": '["0.97"]'}, "text price": {"outcomePrices": '["x","y"]'},
    "ambiguous_outcome": {"outcomePrices": '["0.5","0.5"]'}, "no_clob_token": {"clobTokenIds": "[]"},
}


def test_catalogue_file_gives_one_reason_per_market(spark, tmp_path):
    path = tmp_path / "catalogue.json"
    path.write_text("\n".join(json.dumps({**GOOD, "conditionId": k, **v}) for k, v in CASES.items()))
    parsed = C.read_catalogue(spark, str(path))
    got = {r.market_id: r.reason for r in parsed.select("market_id", C.reject_reason().alias("reason")).collect()}
    passed = {"yes", "no", "real lists"}
    odd = {"bad json": "not_binary", "text price": "no_outcome_field"}
    assert got == {k: None if k in passed else odd.get(k, k) for k in CASES}
    meta = {r.market_id: r for r in C.qualifying(parsed).collect()}
    assert meta["yes"].outcome == 1 and meta["no"].outcome == 0 and meta["yes"].duration_days == 59
    assert meta["yes"].start_date.microsecond == 123000


def test_month_windows_clip_the_last(spark):
    span = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 10))], "lo timestamp_ntz, hi timestamp_ntz")
    assert [(r.window_start.day, r.window_end) for r in C.month_windows(span).orderBy("window_start").collect()][-1] == (1, dt.datetime(2024, 3, 10))


@pytest.mark.parametrize("text,kind,target", [
    ("0x" + "a" * 64, "id", "0x" + "a" * 64), ("https://m.example/event/e1", "event", "e1"), ("m.example/fr/event/e1/m1?x=1", "market", "m1"),
    ("https://m.example/market/m2#top", "market", "m2"), (" will-it-rain ", "slug", "will-it-rain"), ("will it rain", "text", "will it rain")])
def test_lookup_strings(spark, text, kind, target):
    df = spark.createDataFrame([(text,)], "q string")
    assert tuple(df.select(*C.classify_lookup("q", "m.example")).first()) == (kind, target)


def test_newest_evidence_file_wins(spark, tmp_path):
    (tmp_path / "b.csv").write_text("market_id,v\n1,old\n2,only\n")
    time.sleep(1.1)
    (tmp_path / "a.csv").write_text("market_id,v\n1,new\n")
    os.utime(tmp_path / "a.csv")
    got = {r.market_id: r.v for r in TB.read_evidence(spark, str(tmp_path), "market_id string, v string").collect()}
    assert got == {"1": "new", "2": "only"}


def test_meta_csv_keeps_ids_as_text(spark, tmp_path):
    (tmp_path / "m.csv").write_text("market_id,clob_token_id,start_date\nx,00123456789012345678901,2024-01-01T00:00:00Z\ny,7,soon\n")
    rows = TB.read_meta_csv(spark, str(tmp_path / "m.csv"), {"market_id": "string", "clob_token_id": "string", "start_date": "timestamp"}, ["start_date"]).orderBy("market_id").collect()
    assert rows[0].clob_token_id == "00123456789012345678901" and rows[0].start_date == dt.datetime(2024, 1, 1) and rows[1].start_date is None


def test_table_can_be_rewritten_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    assert TB.staged_write(spark.range(10), path) == 10
    assert TB.rewrite(spark, path, path, lambda t: t.filter("id > 3")) == (10, 6)
    assert spark.read.parquet(path).count() == 6
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_failed_rewrite_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    TB.staged_write(spark.range(5), path)
    with pytest.raises(Exception):
        TB.rewrite(spark, path, path, lambda t: t.withColumn("x", F.raise_error(F.lit("stop"))))
    assert spark.read.parquet(path).count() == 5


def test_merge_fresh_ownership(spark):
    old = spark.createDataFrame([(1, "q", "sports", "train"), (2, "q", "crypto", "train")], "market_id int, question string, category string, split string")
    new = spark.createDataFrame([(1, "Q", "x"), (3, "N", "y")], "market_id int, question string, category string")
    got = {r.market_id: (r.question, r.category, r.split, r.merge_kind) for r in TB.merge_fresh(old, new).collect()}
    assert got == {1: ("Q", "sports", "train", "updated"), 2: ("q", "crypto", "train", "kept"), 3: ("N", "y", "test", "added")}


def test_integrity_states(spark):
    cols = "file string, bytes long, sha256 string"
    now = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("d", 1, "z")], cols)
    then = spark.createDataFrame([("a", 1, "x"), ("b", 1, "w"), ("c", 1, "v")], cols)
    assert {r.file: r.state for r in MF.integrity(now, then).collect()} == {"a": "ok", "b": "modified", "c": "missing", "d": "unlisted"}


def test_manifest_and_report(spark, tmp_path, t0):
    meta = spark.createDataFrame([(1, t0)], "market_id int, start_date timestamp_ntz")
    clean = spark.createDataFrame([(1, t0, 1, "train"), (1, t0 + DAY, 1, "test")], "market_id int, snapshot_timestamp timestamp_ntz, outcome int, split string")
    MF.write_manifest(MF.dataset_summary(meta, clean), MF.split_summary(clean), str(tmp_path / "v1"), "v1")
    r = spark.read.json(str(tmp_path / "v1")).first()
    assert r.version == "v1" and r.clean_snapshots == 2 and r.by_split.train.snapshots == 1
    assert MF.markdown_table(MF.split_summary(clean).select("split", "markets").orderBy("split")).splitlines()[2] == "| test | 1 |"
