"""Running sums, percentiles, as-of join, leakage passes and the time split."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles, half_up
from tallycast.functions.running import hash_rank, running_rank, running_sums
from tallycast.operators import leakage as L
from tallycast.operators import trends as T

DAY = dt.timedelta(days=1)


def test_half_up(spark):
    df = spark.createDataFrame([(0.00005,), (0.12344999,), (-0.00006,), (0.3,)], "x double")
    assert [r[0] for r in df.select(half_up("x", 4)).collect()] == [0.0001, 0.1234, -0.0001, 0.3]


def test_running_sums_on_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.randrange(100), i // 50, i // 10) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, v int, a int, b int")
    got = {(r.k, r.i): (r.s, r.tot_s) for r in running_sums(df, ["k"], ["a", "b"], ["i"], {"s": F.col("v")}, totals=True).collect()}
    run = {}
    for k, i, v, *_ in rows:
        run[k] = run.get(k, 0) + v
        assert got[(k, i)][0] == run[k]
    assert all(got[(k, i)][1] == run[k] for k, i, *_ in rows)


def test_ranks(spark):
    df = spark.createDataFrame([(i, i // 4) for i in range(20)], "x int, lvl int")
    assert sorted((r.x, r.pos) for r in running_rank(df, [], ["lvl"], ["x"], "pos").collect()) == [(i, i + 1) for i in range(20)]
    numbered = hash_rank(df.select("x"), "x", "pos").collect()
    assert sorted(r.pos for r in numbered) == list(range(1, 21)) and {r.tot_pos for r in numbered} == {20}


def test_exact_percentiles_match_linear_interpolation(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 50), 2) for _ in range(400)] + [1.25] * 200 + [-1e6, 1e6]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 2.0)], "k string, v double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): r.value for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    for p in probs:
        assert abs(got[("g", p)] - np.percentile(values, p * 100)) < 1e-9
        assert got[("h", p)] == 2.0


def test_asof_join_equals_brute_force(spark, t0):
    rng = random.Random(5)
    right = sorted({(k, t0 + dt.timedelta(hours=rng.randrange(2400))) for k in "ab" for _ in range(60)})
    right = [(k, ts, i) for i, (k, ts) in enumerate(right)]
    left = [(i, rng.choice("abc"), t0 + dt.timedelta(hours=rng.randrange(-100, 2600))) for i in range(500)] + [(900, *right[3][:2])]
    a = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz")
    b = spark.createDataFrame(right, "k string, at timestamp_ntz, v int")
    for join in (T.asof_join, T.asof_join_dense):
        out = join(a, b, "k", "ts", "at", ["v"]).collect()
        assert len(out) == len(left)
        for r in out:
            best = max(((at, v) for k, at, v in right if k == r.k and at <= r.ts), default=(None, None))
            assert r.v == best[1]


def test_trend_week_is_usable_after_seven_days(spark, t0):
    weeks = spark.createDataFrame([("a", t0, 10.0), ("a", t0 + 7 * DAY, 100.0)], "category string, week_start timestamp_ntz, trend_value double")
    snaps = spark.createDataFrame([(1, "a", t0 + 7 * DAY - dt.timedelta(seconds=1)), (2, "a", t0 + 7 * DAY), (3, "a", t0 + 14 * DAY), (4, "z", t0 + 20 * DAY)],
                                  "id int, category string, snapshot_timestamp timestamp_ntz")
    got = {r.id: (r.trend_value, r.trend_spike, r.has_trend_data) for r in T.merge_trends(snaps, T.weekly_features(weeks)).collect()}
    assert got == {1: (0.0, 0, 0), 2: (10.0, 0, 1), 3: (100.0, 1, 1), 4: (0.0, 0, 0)}


def test_keyword_mean_leaves_out_partial_weeks_and_gaps(spark, t0):
    df = spark.createDataFrame([("a", t0, 10, None, False), ("a", t0 + 7 * DAY, 1, 1, True)],
                               "category string, week_start timestamp_ntz, x int, y int, is_partial boolean")
    assert [r.trend_value for r in T.keyword_mean(df, ["x", "y"]).collect()] == [10.0]


def leak_case(spark, t0):
    rows = [(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.97), (1, 3, 0.6), (1, 9, 0.6), (2, 0, 0.5), (2, 5, 0.99), (2, 6, 0.4), (3, 30, 0.5)]
    snaps = spark.createDataFrame([(m, t0 + d * DAY, p, "test") for m, d, p in rows],
                                  "market_id int, snapshot_timestamp timestamp_ntz, price_at_snapshot double, split string")
    closed = spark.createDataFrame([(2, t0 + 4 * DAY), (3, None)], "market_id int, closed_time timestamp_ntz")
    return snaps, closed


def test_first_failing_pass_wins(spark, t0):
    snaps, closed = leak_case(spark, t0)
    marked = L.mark_removed(snaps, closed, F.lit(t0 + 20 * DAY), allowance_days=2)
    got = {(r.market_id, (r.snapshot_timestamp - t0).days): r.removed_by for r in marked.collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): "settled_price", (1, 3): None, (1, 9): "inactivity",
                   (2, 0): None, (2, 5): "closed_time", (2, 6): "closed_time", (3, 30): "inactivity"}
    counts = {r.removed_by: r.n for r in L.removal_counts(marked).collect()}
    assert counts == {"kept": 4, "settled_price": 1, "inactivity": 2, "closed_time": 2}


def test_passes_are_idempotent(spark, t0):
    snaps, closed = leak_case(spark, t0)
    run = lambda df: L.mark_removed(df, closed, F.lit(t0 + 20 * DAY), 2).filter("removed_by IS NULL").select(*snaps.columns)
    once = run(snaps)
    assert sorted(run(once).collect()) == sorted(once.collect())


def test_time_split_counts_and_order(spark, t0):
    rows = [(i, t0 + (i % 4) * DAY, None if i % 2 else t0 + DAY) for i in range(37)]
    meta = spark.createDataFrame(rows, "market_id int, end_date timestamp_ntz, closed_time timestamp_ntz")
    out = L.time_split(meta, 0.8).collect()
    train = [r for r in out if r.split == "train"]
    assert len(out) == 37 and len(train) == int(37 * 0.8)
    when = lambda r: r.closed_time or r.end_date
    assert max(map(when, train)) <= min(when(r) for r in out if r.split == "test")


def test_rows_at_the_cutoff_stay_test(spark, t0):
    df = spark.createDataFrame([(t0, "test"), (t0 - DAY, "test"), (t0 - DAY, "train")], "snapshot_timestamp timestamp_ntz, split string")
    assert [r.split for r in L.mark_pre_cutoff(df, F.lit(t0)).collect()] == ["test", "test_pre_cutoff", "train"]


def test_holdout_drops_rows_before_the_last_fit_resolution(spark, t0):
    meta = spark.createDataFrame([(i, t0 + i * DAY, None) for i in range(10)], "market_id int, end_date timestamp_ntz, closed_time timestamp_ntz")
    train = spark.createDataFrame([(i, t0 + d * DAY) for i in range(10) for d in (6, 7, 8)], "market_id int, snapshot_timestamp timestamp_ntz")
    parts = L.holdout_split(train, meta, 0.2).collect()
    assert {r.market_id for r in parts if r.part == "fit"} == set(range(8))
    assert sorted((r.snapshot_timestamp - t0).days for r in parts if r.part == "holdout") == [7, 7, 8, 8]
    assert sum(r.part == "dropped" for r in parts) == 2
