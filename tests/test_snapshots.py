"""Features against a plain Python computation on hand-made histories."""

from __future__ import annotations

import datetime as dt
import random
from statistics import mean, pstdev

import pytest
from pyspark.sql import functions as F

from tallycast.operators import snapshots as S

HOUR = dt.timedelta(hours=1)
DAY = dt.timedelta(days=1)
META = "market_id long, start_date timestamp_ntz, end_date timestamp_ntz, closed_time timestamp_ntz, duration_days long, total_volume double, outcome int"


def history(t0, seed, n, span_days):
    """Irregular prices, several of them exactly on grid points."""
    rng = random.Random(seed)
    at = {t0 + dt.timedelta(seconds=rng.randrange(int(span_days * 86400))) for _ in range(n)}
    at |= {t0 + 12 * HOUR * k for k in range(0, int(span_days * 2), 3)}
    return [(ts, round(rng.random(), 4)) for ts in sorted(at)]


def slope(ys):
    n = len(ys)
    mx, my = (n - 1) / 2, mean(ys)
    return sum((i - mx) * (y - my) for i, y in enumerate(ys)) / sum((i - mx) ** 2 for i in range(n))


def expected(prices, start, stop):
    out = {}
    ts = start + 14 * DAY
    while ts <= stop and start + 14 * DAY < stop:
        past = [p for t, p in prices if t <= ts]
        if len(past) >= 20:
            row = {"price_at_snapshot": past[-1]}
            for d in (7, 14):
                w = [p for t, p in prices if ts - d * DAY <= t <= ts]
                if len(w) >= 2:
                    row |= {f"price_mean_{d}d": mean(w), f"price_volatility_{d}d": pstdev(w), f"price_min_{d}d": min(w),
                            f"price_max_{d}d": max(w), f"price_change_{d}d": w[-1] - w[0], f"price_range_{d}d": max(w) - min(w),
                            f"price_trend_{d}d": slope(w)}
                else:
                    row |= {c: None for c in S.rolling_columns((d,))}
            out[ts] = row
        ts += 12 * HOUR
    return out


@pytest.fixture(scope="module")
def case(spark, t0):
    markets = [(1, t0, t0 + 40 * DAY, None, 40, 10.0, 1), (2, t0 + HOUR, t0 + 60 * DAY, t0 + 30 * DAY, 59, 5.0, 0),
               (3, t0, t0 + 14 * DAY, None, 14, 5.0, 0)]
    hist = {1: history(t0, 1, 150, 40), 2: history(t0 + HOUR, 2, 40, 16), 3: history(t0, 3, 90, 14)}
    rows = [(m, i, ts, p) for m, ps in hist.items() for i, (ts, p) in enumerate(ps)]
    prices = spark.createDataFrame(rows, "market_id long, event_id long, ts timestamp_ntz, price double")
    return prices, spark.createDataFrame(markets, META), markets, hist


def test_features_equal_plain_computation(case):
    prices, meta, markets, hist = case
    got = {(r.market_id, r.snapshot_timestamp): r for r in S.build_snapshots(prices, meta).collect()}
    want = {(m[0], ts): row for m in markets for ts, row in expected(hist[m[0]], m[1], min(m[2], m[3] or m[2])).items()}
    assert got.keys() == want.keys() and not any(k[0] == 3 for k in got)
    for key, row in want.items():
        for col, value in row.items():
            mine = got[key][col]
            unit = 1e-6 if "trend" in col else 1e-4
            assert (mine is None) == (value is None), (key, col)
            if value is not None:
                assert abs(mine - value) <= unit * 0.51, (key, col, mine, value)


def test_cell_size_does_not_matter(case):
    prices, meta, _, _ = case
    one, many = (S.price_features(prices, meta, cells_per_slot=k) for k in (1, 48))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_no_feature_uses_a_later_price(case, t0):
    prices, meta, _, _ = case
    cut = t0 + 25 * DAY
    early = S.build_snapshots(prices.filter(F.col("ts") <= F.lit(cut)), meta).filter(F.col("snapshot_timestamp") <= F.lit(cut))
    full = S.build_snapshots(prices, meta).filter(F.col("snapshot_timestamp") <= F.lit(cut))
    assert full.exceptAll(early).isEmpty() and early.exceptAll(full).isEmpty()


def test_finish_fills_and_clips(spark):
    cols = S.rolling_columns()
    df = spark.createDataFrame([(1.2, 0.7, *[None] * 14), (0.4, 0.1, *[0.3] * 14)],
                               "price_at_snapshot double, price_deviation_from_half double, " + ", ".join(f"{c} double" for c in cols))
    a, b = S.finish_features(df).orderBy(F.desc("price_at_snapshot")).collect()
    assert a.price_at_snapshot == 1.0 and a.price_deviation_from_half == 0.5
    assert a.price_mean_7d == a.price_max_14d == 1.0 and a.price_trend_14d == a.price_volatility_7d == 0.0
    assert b.price_mean_7d == 0.3
    n = S.finish_counts(df).first()
    assert (n.clipped, n.filled_7d, n.filled_14d) == (1, 1, 1)
