"""NULL keys keep their rows, and NaN stays visible."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles, half_up, half_up_sql
from tallycast.functions.running import running_rank
from test_scores import drawn as drawn_groups

from tallycast.operators import bootstrap as BS
from tallycast.operators import explore as X
from tallycast.operators import leakage, slices
from tallycast.operators import metrics as M


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 3 == 0 else "c%d" % (i % 2), i % 2, (i * 29 % 97) / 100) for i in range(120)]
    return spark.createDataFrame(data, "market_id int, category string, outcome int, p double")


def test_rounding_keeps_nan_and_large_numbers(spark):
    values = [float("nan"), float("inf"), -float("inf"), 1e300, -3e18, None, 2.5, -2.5, 0.125]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for column in (half_up("v", 2), F.expr(half_up_sql("v", 2))):
        got = [r.r for r in df.select("i", column.alias("r")).orderBy("i").collect()]
        assert math.isnan(got[0]) and got[1:5] == values[1:5] and got[5] is None and got[6:] == [2.5, -2.5, 0.13]


def test_null_keys_are_groups(rows):
    auc = {r.category: r.auc for r in M.auc(rows, ["category"]).collect()}
    assert set(auc) == {None, "c0", "c1"} and auc[None] is not None
    assert {r.category for r in M.metric_table(rows, ["category"]).collect()} == set(auc)
    assert {(r.category, r.n) for r in slices.auc_by(rows, ["category"]).collect()} == {(None, 40), ("c0", 40), ("c1", 40)}
    ranks = sorted(r["rank"] for r in running_rank(rows.withColumn("lvl", F.floor("p")), ["category"], ["lvl"], ["p", "market_id"]).filter("category IS NULL").collect())
    assert ranks == list(range(1, 41))
    described = {r.category: r for r in X.describe(rows, ["p"], ["category"]).collect()}
    assert described[None].n == 40 and described[None].q50 is not None
    assert sum(r.n for r in X.value_counts(rows, "outcome", ["category"]).collect()) == 120
    assert sum(r.n for r in X.histogram(rows, F.col("p"), 5, ["category"]).collect()) == 120
    assert {r.category for r in exact_percentiles(rows, ["category"], "p", [0.5]).collect()} == set(auc)
    one = rows.withColumn("market_id", F.when(F.col("market_id") > 3, F.col("market_id")))
    assert M.market_weights(one).count() == 120


def test_baseline_of_null_slices(rows, spark):
    both = rows.withColumn("model", F.lit("market")).unionByName(rows.withColumn("model", F.lit("m")))
    t = M.with_baseline(M.metric_table(both, ["category", "model"]), ["category"], "market", ["auc", "brier"])
    assert t.count() == 6 and t.filter("delta_brier IS NULL").isEmpty()


def test_split_refuses_markets_without_time(spark, t0):
    good = [(i, t0, t0) for i in range(9)]
    frame = lambda rows: spark.createDataFrame(rows, "market_id int, closed_time timestamp_ntz, end_date timestamp_ntz")
    assert leakage.time_split(frame(good)).count() == 9
    with pytest.raises(Exception, match="without closing and end time"):
        leakage.time_split(frame([*good, (99, None, None)])).collect()


@pytest.mark.parametrize("cells, alike", [(0, 16), (0, 2), (8_000_000, 16)])
def test_auc_bootstrap_equals_brute_force(rows, monkeypatch, cells, alike):
    """With draw counts broadcast, joined, and added up for equal scores, each replicate is the AUC of the drawn groups' rows."""
    monkeypatch.setattr(BS, "WEIGHT_CELLS", cells)
    monkeypatch.setattr(BS, "ALIKE", alike)
    df = rows.withColumn("g", F.col("market_id") % 10).withColumn("q", F.round(F.col("p") * 0.5 + F.col("outcome") * 0.1, 2))
    got = BS.bootstrap_auc_diff(df, "p", "q", "g", 30).first()
    data = df.collect()

    def auc(drawn, c):
        pos = [(r[c], w) for r in data if r.outcome == 1 for w in [drawn.count(r.g)] if w]
        neg = [(r[c], w) for r in data if r.outcome == 0 for w in [drawn.count(r.g)] if w]
        pairs = sum(a * b * ((x > y) + 0.5 * (x == y)) for x, a in pos for y, b in neg)
        total = sum(a for _, a in pos) * sum(b for _, b in neg)
        return pairs / total if total else None

    diffs = []
    for b in range(30):
        groups = drawn_groups(range(10), b)
        new, old = auc(groups, "q"), auc(groups, "p")
        diffs += [new - old] if new is not None else []
    assert got.replicates == len(diffs)
    assert got.p_value == pytest.approx(sum(d <= 0 for d in diffs) / len(diffs))
    assert got.point == pytest.approx(auc(list(range(10)), "q") - auc(list(range(10)), "p"))
    at = 0.025 * (len(diffs) - 1)
    low = sorted(diffs)[int(at)] + (at - int(at)) * (sorted(diffs)[int(at) + 1] - sorted(diffs)[int(at)])
    assert got.ci_lo == pytest.approx(low)
