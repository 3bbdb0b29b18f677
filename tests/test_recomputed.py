"""Window features by a second path: equal to the build on sound prices, different where a price was changed."""

from __future__ import annotations

from tallycast.operators import quality as Q
from tallycast.session import cut
from tallycast.sources import views as V

SF = "/root/testdata/sf0.001"
FEATURES = [f"price_{s}_{d}d" for d in (7, 14) for s in Q.RECOMPUTED]


def test_second_path_agrees_and_finds_a_changed_price(spark):
    stored = cut(V.raw_snapshots(spark, SF).select("market_id", "snapshot_timestamp", *FEATURES))
    prices = V.prices(spark, SF)
    sound = Q.parity(stored, Q.recompute_windows(stored, prices), ["market_id", "snapshot_timestamp"], FEATURES, 1e-6).collect()
    nulls = {c: stored.filter(f"{c} IS NULL").count() for c in FEATURES}
    assert len(sound) == len(FEATURES) and all(r.n > 0 and r.off == 0 and r.absent == nulls[r.feature] for r in sound)
    one = stored.filter("price_mean_7d IS NOT NULL").orderBy("market_id", "snapshot_timestamp").first()
    changed = prices.selectExpr("market_id", "event_id", "ts", f"CASE WHEN market_id = {one.market_id} THEN price / 2 + 0.001 ELSE price END AS price")
    found = {r.feature: r.off for r in Q.parity(stored, Q.recompute_windows(stored, changed), ["market_id", "snapshot_timestamp"], FEATURES, 1e-6).collect()}
    assert found["price_mean_7d"] > 0 and found["price_max_14d"] > 0
