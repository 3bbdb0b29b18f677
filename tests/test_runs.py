"""Jobs that go on over several runs: first lookups as change rows, builds that append, ingestion with a look-back."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest

from tallycast.operators.live import first_lookups
from tallycast.sources import catalogue as C
from tallycast.sources import tables as TB
from tallycast.streaming import jobs as R

LOOKUPS = "source string, market_id long, lookup_id long, ts timestamp_ntz, release string"


def folders(path):
    return sorted(int(p.name[2:]) for p in Path(path).glob("v=*"))


def test_first_lookups_write_changes_only(spark, tmp_path, t0):
    rng = random.Random(4)
    landing, state, rows, seen = str(tmp_path / "landing"), str(tmp_path / "state"), [], 0
    for run in range(7):
        new = [(rng.choice(["sample", "search", None]), rng.choice([None, *range(30)]), 1000 * run + i, t0 + dt.timedelta(hours=rng.randrange(500)), rng.choice(["r1", "r1", None]))
               for i in range(40)]
        rows += new
        spark.createDataFrame(new, LOOKUPS).coalesce(1).write.mode("append").parquet(landing)
        out = R.keep_first(spark.readStream.schema(LOOKUPS).parquet(landing), spark, state, compact_every=2)
        want = first_lookups(spark.createDataFrame(rows, LOOKUPS))
        got = sorted(map(str, out.select("source", "market_id", "lookup_id").collect()))
        assert got == sorted(map(str, want.select("source", "market_id", "lookup_id").collect()))
        last = folders(f"{state}/changes")[-1]
        changed = spark.read.parquet(f"{state}/changes/v={last}")
        assert changed.count() <= 40 and {r.lookup_id // 1000 for r in changed.collect()} <= {run}
        seen = max(seen, len(folders(f"{state}/changes")))
    assert seen < 6 and len(folders(f"{state}/base")) <= 2


def test_a_run_without_new_files_changes_nothing(spark, tmp_path, t0):
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")
    spark.createDataFrame([("sample", 1, 1, t0, "r1")], LOOKUPS).write.parquet(landing)
    for _ in range(2):
        out = R.keep_first(spark.readStream.schema(LOOKUPS).parquet(landing), spark, state)
        assert [r.lookup_id for r in out.collect()] == [1]


def test_ingestion_goes_on_over_runs(spark, tmp_path):
    """A repeated key, a late one within thirty days, one beyond; the same in the checkpoint's second and third run."""
    landing, path = str(tmp_path / "landing"), str(tmp_path / "ingest")
    day = lambda n: dt.datetime(2024, 5, 1) + dt.timedelta(days=n)
    schema, runs = "market_id long, end_date timestamp, run int", [[(1, 0), (2, 60)], [(1, 0), (2, 60), (3, 31), (4, 29), (9, 30)], [(3, 31), (5, 90), (6, 45)], [(7, 59), (8, 61)]]
    for k, rows in enumerate(runs):
        spark.createDataFrame([(m, day(n), k) for m, n in rows], schema).coalesce(1).write.mode("append").parquet(landing)
        out = R.run_to_table(R.ingest(spark.readStream.schema(schema).parquet(landing), "market_id", "end_date"), spark, path)
    assert sorted((r.market_id, r.run) for r in out.collect()) == [(1, 0), (2, 0), (3, 1), (5, 2), (6, 2), (8, 3), (9, 1)]


def test_builds_append_and_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "table")
    table = lambda: sorted((r.market_id, r.x, r.build) for r in spark.read.parquet(path).collect())
    rows = lambda *r: spark.createDataFrame(list(r), "market_id long, x int")
    TB.append_build(rows((1, 1), (2, 1)), path, 1)
    TB.append_build(rows((2, 9)), path, 2)  # breaks off here, as it were
    for _ in range(2):
        TB.append_build(rows((2, 9), (3, 2), (3, 3)), path, 2)
        assert table() == [(1, 1, 1), (2, 1, 1), (3, 2, 2), (3, 3, 2)]
    TB.append_build(rows((2, 5)), path, 3, full=True)
    assert table() == [(2, 5, 3)]


@pytest.mark.parametrize("record, key", [('{"conditionId": "0xa", "id": "7"}', "0xa"), ('{"id": 7}', "7"), ('{"conditionId": "", "id": "7"}', "7"), ("{}", None)])
def test_catalogue_key_falls_back_to_the_id(spark, record, key):
    assert C.from_lines(spark.createDataFrame([(record,)], "record string")).first()["market_id"] == key
