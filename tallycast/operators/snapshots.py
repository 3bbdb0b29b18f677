"""Point-in-time features on a regular snapshot grid.

A market's snapshots lie `interval_hours` apart, starting `burn_in_days` after its start, so a
window of whole days is a whole number of slots between grid points. Prices are therefore summed
once per slot; every window is then a frame over slots, whose number is bounded by the market's
lifetime and not by its trade count. Only the ranking of prices (for the slope over observation
numbers) needs a sort, and that happens inside cells of a slot, so one busy market spreads over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up, half_up_sql
from tallycast.functions.timing import DAY, HOUR, ceil_div, days_between, from_micros, micros

ROLLING_STATS = ["mean", "volatility", "min", "max", "change", "range", "trend"]
FILL_WITH_PRICE = ["mean", "min", "max"]
FILL_WITH_ZERO = ["volatility", "change", "range", "trend"]
WINDOW_DAYS = (7, 14)
MID = 0.5


def rolling_columns(window_days=WINDOW_DAYS) -> list[str]:
    return [f"price_{s}_{w}d" for w in window_days for s in ROLLING_STATS]


def snapshot_grid(markets: DataFrame, interval_hours: int = 12, burn_in_days: int = 14) -> DataFrame:
    """One row per market and grid point from start + burn-in to the earlier of end and close, inclusive."""
    step = interval_hours * HOUR
    first_slot = burn_in_days * DAY // step
    start, end = micros("start_date"), micros("end_date")
    stop = F.least(end, F.coalesce(micros("closed_time"), end))
    last_slot = F.call_function("div", stop - start, F.lit(step))
    return (
        markets.filter(stop - start > burn_in_days * DAY)
        .withColumn("start_us", start)
        .withColumn("slot", F.explode(F.sequence(F.lit(first_slot).cast("long"), last_slot)))
        .withColumn("snapshot_us", F.col("start_us") + F.col("slot") * step)
    )


def slot_sums(prices: DataFrame, markets: DataFrame, interval_hours: int = 12, cells_per_slot: int = 12) -> DataFrame:
    """Per (market, slot): count, sums, extremes, first and last price, and the same for prices that
    fall exactly on the slot's closing grid point (they also belong to the window that opens there)."""
    step = interval_hours * HOUR
    cell_us = step // cells_per_slot
    offset = F.col("price_us") - F.col("start_us")
    located = (
        prices.select("market_id", "event_id", "price", micros("ts").alias("price_us"))
        .join(markets.select("market_id", micros("start_date").alias("start_us")), "market_id")
        .select(
            "market_id", "event_id", "price", "price_us",
            ceil_div(offset, cell_us).alias("cell"),
            ceil_div(offset, step).alias("slot"),
            (offset % step == 0).alias("on_grid"),
        )
    )
    numbered = located.selectExpr(
        "market_id", "cell", "slot", "on_grid", "price", f"price - {MID}D AS q",
        "row_number() OVER (PARTITION BY market_id, cell ORDER BY price_us, event_id) AS i",
    )
    sums = {"n": "count(q)", "s1": "sum(q)", "s2": "sum(q * q)", "iq": "sum(i * q)", "lo": "min(price)", "hi": "max(price)",
            "first": "min_by(price, i)", "last": "max_by(price, i)"}
    edge = [F.expr(f"{agg} FILTER (WHERE on_grid) AS e_{name}") for name, agg in sums.items() if name != "last"]
    cells = numbered.groupBy("market_id", "cell", "slot").agg(*[F.expr(f"{agg} AS {name}") for name, agg in sums.items()], *edge)
    placed = cells.selectExpr(
        "*", "coalesce(sum(n) OVER (PARTITION BY market_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    merged = {**{c: f"sum({c})" for c in ("n", "s1", "s2", "e_n", "e_s1", "e_s2")},
              "iq": "sum(before * s1 + iq)", "e_iq": "sum(before * e_s1 + e_iq)",
              "lo": "min(lo)", "hi": "max(hi)", "e_lo": "min(e_lo)", "e_hi": "max(e_hi)",
              "first": "min_by(first, cell)", "last": "max_by(last, cell)", "e_first": "max(e_first)"}
    return placed.groupBy("market_id", "slot").agg(*[F.expr(f"{agg} AS {name}") for name, agg in merged.items()])


def price_features(
    prices: DataFrame, markets: DataFrame, interval_hours: int = 12, burn_in_days: int = 14,
    min_prices: int = 20, window_days=WINDOW_DAYS, cells_per_slot: int = 12,
) -> DataFrame:
    """The markets' columns per snapshot with price and rolling columns, these NULL below two prices.

    Market columns travel with the grid rows, so no join follows the windows.
    """
    step = interval_hours * HOUR
    carried = [c for c in markets.columns if c != "market_id"]
    grid = snapshot_grid(markets, interval_hours, burn_in_days).select("market_id", "slot", "snapshot_us", *carried)
    slots = slot_sums(prices, markets, interval_hours, cells_per_slot)
    timeline = slots.unionByName(grid, allowMissingColumns=True)
    framed = timeline.selectExpr("market_id", "snapshot_us", *carried, *_frame_columns(step, window_days))
    rows = framed.filter(F.col("snapshot_us").isNotNull() & (F.col("n_prices") >= min_prices))
    moments = rows.selectExpr("*", *_moment_columns(window_days))
    return moments.selectExpr(
        "market_id", "snapshot_us", *carried, "n_prices",
        f"{half_up_sql('price_now', 4)} AS price_at_snapshot",
        f"{half_up_sql('abs(price_now - 0.5D)', 4)} AS price_deviation_from_half",
        *_statistic_columns(window_days),
    )


def _frame_columns(step: int, window_days) -> list[str]:
    """Sums and extremes over the slots of each window, plus the prices on the grid point where it opens."""
    by_slot = "OVER (PARTITION BY market_id ORDER BY slot RANGE BETWEEN {} AND {})"
    past = by_slot.format("UNBOUNDED PRECEDING", "CURRENT ROW")
    cols = [f"sum(n) {past} AS n_prices", f"last(last, true) {past} AS price_now"]
    for d in window_days:
        width = d * DAY // step
        inside = by_slot.format(f"{width - 1} PRECEDING", "CURRENT ROW")
        edge = by_slot.format(f"{width} PRECEDING", f"{width} PRECEDING")
        cols += [f"coalesce(sum({c}) {inside}, 0) + coalesce(sum(e_{c}) {edge}, 0) AS {c}_{d}" for c in ("n", "s1", "s2", "iq")]
        cols += [
            f"least(min(lo) {inside}, min(e_lo) {edge}) AS lo_{d}",
            f"greatest(max(hi) {inside}, max(e_hi) {edge}) AS hi_{d}",
            f"coalesce(max(e_first) {edge}, first(first, true) {inside}) AS first_{d}",
        ]
    return cols


def _moment_columns(window_days) -> list[str]:
    """Mean, variance and slope over observation numbers. The numbers in a window are consecutive and end
    at n_prices, which gives their mean and variance in closed form."""
    cols = []
    for d in window_days:
        n, s1 = f"n_{d}", f"s1_{d}"
        cols += [
            f"CASE WHEN {n} >= 2 THEN {s1} / {n} END AS mean_{d}",
            f"CASE WHEN {n} >= 2 THEN greatest(s2_{d} / {n} - ({s1} / {n}) * ({s1} / {n}), 0D) END AS var_{d}",
            f"CASE WHEN {n} >= 2 THEN (iq_{d} - (n_prices - ({n} - 1) / 2D) * {s1}) / ({n} * (CAST({n} AS DOUBLE) * {n} - 1) / 12D) END AS slope_{d}",
        ]
    return cols


def _statistic_columns(window_days) -> list[str]:
    cols = []
    for d in window_days:
        enough = f"n_{d} >= 2"
        stats = {
            "mean": half_up_sql(f"mean_{d} + {MID}D", 4),
            "volatility": half_up_sql(f"sqrt(var_{d})", 4),
            "min": half_up_sql(f"lo_{d}", 4),
            "max": half_up_sql(f"hi_{d}", 4),
            "change": half_up_sql(f"price_now - first_{d}", 4),
            "range": half_up_sql(f"hi_{d} - lo_{d}", 4),
            "trend": half_up_sql(f"slope_{d}", 6),
        }
        cols += [f"CASE WHEN {enough} THEN {stats[s]} END AS price_{s}_{d}d" for s in ROLLING_STATS]
    return cols


def build_snapshots(prices: DataFrame, markets: DataFrame, **settings) -> DataFrame:
    """The raw feature table: keys, time features, price features, volume, label and descriptive columns."""
    rows = price_features(prices, markets, **settings)
    left = (micros("end_date") - F.col("snapshot_us")) / float(DAY)
    elapsed = (F.col("snapshot_us") - micros("start_date")) / (micros("end_date") - micros("start_date")).cast("double")
    rolling = [c for c in rows.columns if c in rolling_columns(settings.get("window_days", WINDOW_DAYS))]
    described = [c for c in ("split", "category", "question") if c in rows.columns]
    return rows.select(
        "market_id",
        from_micros("snapshot_us").alias("snapshot_timestamp"),
        half_up(left, 2).alias("days_before_close"),
        half_up(F.least(F.greatest(elapsed, F.lit(0.0)), F.lit(1.0)), 4).alias("pct_lifetime_elapsed"),
        "duration_days",
        "price_at_snapshot",
        "price_deviation_from_half",
        "total_volume",
        half_up(F.log1p("total_volume"), 4).alias("log_volume"),
        "outcome",
        *rolling,
        *described,
    )


def clip_price(df: DataFrame) -> DataFrame:
    """Price into [0, 1], distance from one half recomputed."""
    price = F.greatest(F.least(F.col("price_at_snapshot"), F.lit(1.0)), F.lit(0.0))
    return df.withColumn("price_at_snapshot", price).withColumn(
        "price_deviation_from_half", half_up(F.abs(F.col("price_at_snapshot") - 0.5), 4)
    )


def fill_rolling(df: DataFrame, window_days=WINDOW_DAYS) -> DataFrame:
    """Windows without statistics become flat at the current price."""
    filled = {}
    for d in window_days:
        empty = f"price_mean_{d}d IS NULL"
        flat = half_up_sql("price_at_snapshot", 4)
        filled |= {f"price_{s}_{d}d": f"CASE WHEN {empty} THEN {flat} ELSE price_{s}_{d}d END" for s in FILL_WITH_PRICE}
        filled |= {f"price_{s}_{d}d": f"CASE WHEN {empty} THEN 0D ELSE price_{s}_{d}d END" for s in FILL_WITH_ZERO}
    return df.selectExpr(*[f"{filled[c]} AS {c}" if c in filled else c for c in df.columns])


def finish_features(df: DataFrame, window_days=WINDOW_DAYS) -> DataFrame:
    return fill_rolling(clip_price(df), window_days)


def finish_counts(df: DataFrame, window_days=WINDOW_DAYS) -> DataFrame:
    """How many rows the finishing step clips and fills."""
    price = F.col("price_at_snapshot")
    return df.agg(
        F.count_if((price < 0) | (price > 1)).alias("clipped"),
        *[F.count_if(F.col(f"price_mean_{d}d").isNull()).alias(f"filled_{d}d") for d in window_days],
    )
