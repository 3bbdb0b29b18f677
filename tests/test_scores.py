"""Metrics, bootstrap and backtest on small tables with ties, one-class slices and weights."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections import Counter
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.operators import backtest as B
from tallycast.operators import bootstrap as BS
from tallycast.operators import metrics as M
from tallycast.operators import slices as S

DAY = dt.timedelta(days=1)


def brute_auc(ys, ps, ws=None):
    ws = ws or [1] * len(ys)
    num = den = 0.0
    for y1, p1, w1 in zip(ys, ps, ws):
        for y0, p0, w0 in zip(ys, ps, ws):
            if y1 == 1 and y0 == 0:
                den += w1 * w0
                num += w1 * w0 * (1 if p1 > p0 else 0.5 if p1 == p0 else 0)
    return num / den if den else None


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(11)
    return [(i, i // 4, rng.randrange(2), round(rng.random(), 1), round(rng.random(), 3), rng.random() + 0.1) for i in range(80)]


@pytest.fixture(scope="module")
def table(spark, sample):
    return spark.createDataFrame(sample, "id int, market_id int, outcome int, p double, q double, w double")


def test_auc_with_ties_and_weights(table, sample):
    ys, ps, ws = ([r[k] for r in sample] for k in (2, 3, 5))
    assert M.auc(table, []).first().auc == pytest.approx(brute_auc(ys, ps), abs=1e-12)
    assert M.auc(table, [], weight="w").first().auc == pytest.approx(brute_auc(ys, ps, ws), abs=1e-12)


def test_auc_is_unchanged_by_monotone_maps(table):
    assert M.auc(table, [], "q").first().auc == pytest.approx(M.auc(table.withColumn("q", F.col("q") * F.col("q") / 2), [], "q").first().auc, abs=1e-12)


def test_one_class_has_no_auc(table):
    got = {r.market_id: r.auc for r in M.auc(table.filter("outcome = 1 OR market_id = 0"), ["market_id"]).collect()}
    assert all(v is None for k, v in got.items() if k != 0)


def test_metric_table(table, sample):
    r = M.metric_table(table, []).first()
    ys, ps = np.array([s[2] for s in sample]), np.clip(np.array([s[3] for s in sample]), 1e-6, 1 - 1e-6)
    ap, pos = 0.0, ys.sum()
    for t in sorted(set(ps), reverse=True):
        hit = ps >= t
        ap += ys[ps == t].sum() / pos * ys[hit].sum() / hit.sum()
    assert r.n == 80 and r.pr_auc == pytest.approx(ap)
    assert r.log_loss == pytest.approx(-np.mean(ys * np.log(ps) + (1 - ys) * np.log(1 - ps)))
    assert r.brier == pytest.approx(np.mean((ps - ys) ** 2))


def test_best_threshold_is_the_lowest_best_score(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.1)], "outcome int, p double")
    r = M.best_f1_threshold(df, []).first()
    assert r.threshold == 0.4 and r.f1 == pytest.approx(1.0, abs=1e-6)
    assert M.best_grid_threshold(df, []).first().threshold == 0.21


def test_bin_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0)], "p double")
    left = [r[0] for r in df.select(M.left_closed_bin(F.col("p"))).collect()]
    right = [r[0] for r in df.select(M.right_closed_bin(F.col("p"))).collect()]
    assert left == [0, 1, 2, 5, 6, 9] and right == [0, 0, 2, 5, 6, 9]


def test_calibration_error(spark):
    df = spark.createDataFrame([(1, 0.85), (0, 0.85), (0, 0.05)], "outcome int, p double")
    assert M.expected_calibration_error(df, []).first().ece == pytest.approx((0.7 + 0.05) / 3)


def test_market_weights_count_each_market_once(table):
    w = M.market_weights(table.unionByName(table.filter("market_id = 3")), name="mw")
    sums = {r.market_id: r.s for r in w.groupBy("market_id").agg(F.sum("mw").alias("s")).collect()}
    assert len({round(s, 9) for s in sums.values()}) == 1
    assert w.agg(F.avg("mw")).first()[0] == pytest.approx(1.0)


def drawn(groups, b, seed=42):
    """The groups of one replicate: slots choose leaves, leaves choose among their own groups."""
    def mix(x):
        x = x * 2146121005 % 2**31
        x = (x ^ x >> 15) * 74229387 % 2**31
        return x ^ x >> 13

    order = sorted(groups, key=lambda g: (hashlib.md5(str(g).encode()).hexdigest(), g))
    n, key, leaves = len(order), mix((b + seed * 7919 + 1) % 2**31), Counter()
    for slot in range(n):
        high = mix(key ^ slot)
        leaves[(high * 2**31 + mix((high + key) % 2**31)) % n // BS.LEAF] += 1
    return [order[leaf * BS.LEAF + mix(mix(key ^ (leaf + 1)) ^ j) % min(BS.LEAF, n - leaf * BS.LEAF)] for leaf, c in leaves.items() for j in range(c)]


@pytest.mark.parametrize("leaf", [3, 1024])
def test_bootstrap_auc_equals_explicit_resampling(table, sample, leaf, monkeypatch):
    monkeypatch.setattr(BS, "LEAF", leaf)
    diffs = []
    for b in range(12):
        rows = [r for g in drawn({s[1] for s in sample}, b) for r in sample if r[1] == g]
        ys = [r[2] for r in rows]
        if len(set(ys)) == 2:
            diffs.append(brute_auc(ys, [r[4] for r in rows]) - brute_auc(ys, [r[3] for r in rows]))
    r = BS.bootstrap_auc_diff(table, "p", "q", "market_id", 12).first()
    lo, hi = np.percentile(diffs, [2.5, 97.5])
    assert (r.ci_lo, r.ci_hi) == (pytest.approx(lo, abs=1e-12), pytest.approx(hi, abs=1e-12))
    assert r.replicates == len(diffs) and r.p_value == pytest.approx(np.mean(np.array(diffs) <= 0))


@pytest.mark.parametrize("leaf", [3, 1024])
def test_loss_bootstrap_equals_explicit_resampling(spark, leaf, monkeypatch):
    """A NULL group is drawn like others, missing values count as nothing, infinite ones only where drawn."""
    monkeypatch.setattr(BS, "LEAF", leaf)
    values = {g: (float(g % 5) - 2, 1.0 + g % 3) for g in range(17)}
    values[3], values[5] = (None, 2.0), (float("inf"), 1.0)
    rows = spark.createDataFrame([(g, *v) for g, v in values.items()], "g long, a double, n double")
    got = BS.bootstrap_ratio(rows, "g", {"r": ("a", "n")}, 40).first()
    picked = [drawn(values, b) for b in range(40)]
    assert all(len(p) == 17 for p in picked)
    want = [sum(values[g][0] or 0.0 for g in p) / sum(values[g][1] for g in p) for p in picked]
    assert got.replicates == 40 and got.p_value == pytest.approx(np.mean(np.array(want) <= 0))
    assert got.ci_lo == pytest.approx(np.percentile(want, 2.5))
    with_null = rows.union(spark.createDataFrame([(None, 1000.0, 1.0)], rows.schema))
    assert BS.bootstrap_ratio(with_null.where("g is null or g <> 5"), "g", {"r": ("a", "n")}, 40).first().ci_hi > 20


def test_draws_are_spread_evenly(spark):
    """Means and deviations of draw counts are those of a multinomial with equal shares."""
    n, boots = 2500, 200
    vectors = {r.idx: np.frombuffer(r.drawn, np.uint16) for r in BS.draw_vectors(spark, n, boots, 7).collect()}
    counts = np.stack([vectors[i] for i in range(n)]).astype(float)
    assert (counts.sum(0) == n).all()
    assert abs(counts.var() - (1 - 1 / n)) < 0.02 and abs((counts == 0).mean() - np.exp(-1)) < 0.003
    assert abs(np.corrcoef(counts[:, 0], counts[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(counts[:-1].ravel(), counts[1:].ravel())[0, 1]) < 0.01


def test_bootstrap_does_not_depend_on_partitioning(table):
    a = BS.bootstrap_loss_diff(table.repartition(1), "p", "q", "market_id", 10).orderBy("measure").collect()
    b = BS.bootstrap_loss_diff(table.repartition(7), "p", "q", "market_id", 10).orderBy("measure").collect()
    for x, y in zip(a, b):
        assert x.ci_lo == pytest.approx(y.ci_lo, abs=1e-12) and x.point == pytest.approx(y.point, abs=1e-12)


TRADES = [(1, 2, 1, 0.4, 0.5), (1, 1, 1, 0.4, 0.3), (2, 1, 0, 0.6, 0.61), (3, 1, 0, 0.2, 0.1)]


@pytest.fixture(scope="module")
def trade_rows(spark, t0):
    return spark.createDataFrame([(m, t0 + d * DAY, y, p, q) for m, d, y, p, q in TRADES],
                                 "market_id int, ts timestamp_ntz, outcome int, price_at_snapshot double, q double")


def test_trade_rules(trade_rows):
    rows = B.strategies(trade_rows, {"m": "q"}, trade_rows.columns)
    got = {r.strategy: r for r in B.summary(B.trades(rows, 0.02, 0.01), ["strategy"]).collect()}
    m = got["m"]
    assert m.trades == 3 and m.markets == 2
    assert m.profit == pytest.approx((0.6 - 0.01) + (-0.6 - 0.01) + (0.2 - 0.01))
    assert m.capital == pytest.approx(0.41 + 0.61 + 0.81) and m.win_rate == pytest.approx(2 / 3)
    assert got["always_no"].trades == got["always_yes"].trades == 4
    assert got["always_no"].profit == pytest.approx(-got["always_yes"].profit - 8 * 0.01)


def test_first_trade_and_sweep_agree_with_the_plain_rules(trade_rows):
    firsts = {(r.strategy, r.market_id): r for r in B.first_trades(trade_rows, {"m": "q"}, ["ts"]).collect()}
    assert firsts[("m", 1)].profit == pytest.approx(-0.6) and ("m", 2) not in firsts
    rows = B.strategies(trade_rows, {"m": "q"}, trade_rows.columns)
    for tau, cost in ((0.005, 0.0), (0.02, 0.02)):
        want = {r.strategy: r for r in B.summary(B.trades(rows, tau, cost), ["strategy"]).collect()}
        swept = B.sweep(rows, ["strategy"], [0.005, 0.02], [0.0, 0.02]).filter((F.col("tau") == tau) & (F.col("cost") == cost)).collect()
        assert {r.strategy for r in swept} == set(want)
        for r in swept:
            for c in ("trades", "markets", "profit", "capital", "win_rate", "roi"):
                assert r[c] == pytest.approx(want[r.strategy][c])


def test_no_trades_give_no_return(trade_rows):
    none = B.trades(B.strategies(trade_rows, {"m": "q"}, trade_rows.columns).filter("strategy = 'm'"), 0.9)
    r = B.summary(none, []).first()
    assert r.trades == 0 and r.roi is None and r.win_rate is None


def test_nearest_rows_ties_and_tolerance(spark, t0):
    df = spark.createDataFrame([(1, t0, 9.0), (1, t0 + DAY, 11.0), (2, t0, 20.0)], "market_id int, ts timestamp_ntz, pos double")
    got = B.nearest_rows(df, [10], F.col("pos"), ["ts"], ["ts", "pos"], 2.0).collect()
    assert [(r.market_id, r.pos) for r in got] == [(1, 9.0)]


def test_buckets(spark):
    df = spark.createDataFrame([(90, 1.0), (91, 6.99), (365, 7.0), (366, 30.0)], "d int, left double")
    got = df.select(S.closed("d", S.DURATION).alias("a"), S.half_open("left", S.TIME_LEFT).alias("b")).collect()
    assert [r.a for r in got] == ["<=90d", "91-180d", "181-365d", ">365d"] and [r.b for r in got] == ["1-7d", "1-7d", "7-14d", ">=30d"]


def test_quantile_bins_merge_repeated_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 6 + [2.0, 3.0, 4.0, 5.0]], "v double")
    got = sorted((r.v, r.bin) for r in S.quantile_bins(df, "v", 4).distinct().collect())
    assert got[0] == (1.0, 1) and [b for _, b in got] == sorted(b for _, b in got) and got[-1][1] == 2
    assert math.isclose(got[-1][0], 5.0)
