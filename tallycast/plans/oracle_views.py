"""The domain views as plain SQL, for the side-by-side check of every query.

Each view is written from its definition, with range joins and ordinary aggregates, and not from
the way the Spark jobs compute it.
"""

from __future__ import annotations


def r(expr: str, digits: int) -> str:
    scale = "1" + "0" * digits + ".0"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.500001) / {scale})"


def _window(d: int) -> str:
    inside = f"p.ts >= g.snapshot_timestamp - INTERVAL {d} DAY"
    n = f"count(*) FILTER (WHERE {inside})"
    stats = {
        "mean": r(f"avg(p.price) FILTER (WHERE {inside})", 4),
        "volatility": r(f"stddev_pop(p.price) FILTER (WHERE {inside})", 4),
        "min": r(f"min(p.price) FILTER (WHERE {inside})", 4),
        "max": r(f"max(p.price) FILTER (WHERE {inside})", 4),
        "change": r(f"max_by(p.price, p.i) - min_by(p.price, p.i) FILTER (WHERE {inside})", 4),
        "range": r(f"max(p.price) FILTER (WHERE {inside}) - min(p.price) FILTER (WHERE {inside})", 4),
        "trend": r(f"regr_slope(p.price, p.i) FILTER (WHERE {inside})", 6),
    }
    return ", ".join(f"CASE WHEN {n} >= 2 THEN {sql} END AS price_{s}_{d}d" for s, sql in stats.items())


def _filled(d: int) -> str:
    empty = f"price_mean_{d}d IS NULL"
    cols = [f"CASE WHEN {empty} THEN price_at_snapshot ELSE price_{s}_{d}d END AS price_{s}_{d}d" for s in ("mean", "min", "max")]
    cols += [
        f"CASE WHEN {empty} THEN 0.0::DOUBLE ELSE price_{s}_{d}d END AS price_{s}_{d}d"
        for s in ("volatility", "change", "range", "trend")
    ]
    return ", ".join(cols)


_PRICE = r("least(value, 100.0) / 100.0", 4)

VIEWS: dict[str, tuple[list[str], str]] = {
    "prices": ([], f"SELECT user_id AS market_id, event_id, ts, {_PRICE} AS price FROM events"),
    "markets_unsplit": (
        ["prices"],
        f"""
        SELECT m.market_id, 'tok-' || m.market_id AS clob_token_id,
               'Will the ' || first_type || ' count pass ' || m.market_id || '?' AS question,
               CASE WHEN m.market_id % 10 = 9 THEN 'other' ELSE first_type END AS category,
               start_date, end_date,
               CAST(floor((epoch_us(end_date) - epoch_us(start_date)) / 86400000000.0) AS BIGINT) AS duration_days,
               total_volume, yes_final_price,
               CASE WHEN yes_final_price >= 0.5 THEN 1 ELSE 0 END AS outcome,
               CASE WHEN m.market_id % 5 <> 0 THEN end_date - to_days(CAST(m.market_id % 4 AS INTEGER)) END AS closed_time
        FROM (SELECT user_id AS market_id, min(ts) AS start_date,
                     min(ts) + to_days(CAST(20 + user_id % 12 AS INTEGER)) AS end_date,
                     {r("sum(value)", 2)} AS total_volume
              FROM events GROUP BY user_id) m
        JOIN (SELECT user_id AS market_id,
                     max(CASE WHEN up = 1 THEN event_type END) AS first_type,
                     max(CASE WHEN down = 1 THEN {_PRICE} END) AS yes_final_price
              FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up,
                              row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down
                    FROM events)
              GROUP BY user_id) f ON f.market_id = m.market_id
        """,
    ),
    "markets": (
        ["markets_unsplit"],
        """
        SELECT * EXCLUDE (pos, n), CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY coalesce(closed_time, end_date), md5(CAST(market_id AS VARCHAR))) AS pos,
                     count(*) OVER () AS n FROM markets_unsplit)
        """,
    ),
    "grid": (
        ["markets"],
        """
        SELECT market_id, start_date, end_date,
               unnest(generate_series(start_date + INTERVAL 14 DAY, stop, INTERVAL 12 HOUR)) AS snapshot_timestamp
        FROM (SELECT *, least(end_date, coalesce(closed_time, end_date)) AS stop FROM markets)
        WHERE start_date + INTERVAL 14 DAY < stop
        """,
    ),
    "raw_snapshots": (
        ["grid"],
        f"""
        SELECT f.market_id, f.snapshot_timestamp,
               {r("(epoch_us(m.end_date) - epoch_us(f.snapshot_timestamp)) / 86400000000.0", 2)} AS days_before_close,
               {r("least(greatest((epoch_us(f.snapshot_timestamp) - epoch_us(m.start_date)) / CAST(epoch_us(m.end_date) - epoch_us(m.start_date) AS DOUBLE), 0.0), 1.0)", 4)} AS pct_lifetime_elapsed,
               m.duration_days, f.price_at_snapshot, f.price_deviation_from_half, m.total_volume,
               {r("ln(1 + m.total_volume)", 4)} AS log_volume, m.outcome,
               f.* EXCLUDE (market_id, snapshot_timestamp, price_at_snapshot, price_deviation_from_half),
               m.split, m.category, m.question
        FROM (SELECT g.market_id, g.snapshot_timestamp,
                     {r("max_by(p.price, p.i)", 4)} AS price_at_snapshot,
                     {r("abs(max_by(p.price, p.i) - 0.5)", 4)} AS price_deviation_from_half,
                     {_window(7)}, {_window(14)}
              FROM grid g
              JOIN (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ts, event_id) AS i FROM prices) p
                ON p.market_id = g.market_id AND p.ts <= g.snapshot_timestamp
              GROUP BY g.market_id, g.snapshot_timestamp HAVING count(*) >= 20) f
        JOIN markets m ON m.market_id = f.market_id
        """,
    ),
    "snapshots": (
        ["raw_snapshots"],
        f"""
        SELECT market_id, snapshot_timestamp, days_before_close, pct_lifetime_elapsed, duration_days, price_at_snapshot,
               {r("abs(price_at_snapshot - 0.5)", 4)} AS price_deviation_from_half,
               total_volume, log_volume, outcome, {_filled(7)}, {_filled(14)}, split, category, question
        FROM (SELECT * REPLACE (greatest(least(price_at_snapshot, 1.0), 0.0) AS price_at_snapshot) FROM raw_snapshots)
        """,
    ),
    "trend_values": (
        [],
        f"""SELECT event_type AS category, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start, {r("avg(value)", 2)} AS trend_value
            FROM events GROUP BY 1, 2""",
    ),
    "trends": (
        ["trend_values"],
        f"""
        SELECT category, week_start, trend_value, trend_ma4, coalesce(change, 0.0) AS trend_change_4w,
               CASE WHEN trend_value > 1.5 * trend_ma4 THEN 1 ELSE 0 END AS trend_spike, 1 AS has_trend_data
        FROM (SELECT *, {r("avg(trend_value) OVER (PARTITION BY category ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", 2)} AS trend_ma4,
                     {r("trend_value - lag(trend_value, 4) OVER (PARTITION BY category ORDER BY week_start)", 2)} AS change
              FROM trend_values)
        UNION ALL
        SELECT 'other', week_start, 0.0, 0.0, 0.0, 0, 0 FROM trend_values
        WHERE category = (SELECT min(category) FROM trend_values)
        """,
    ),
    "with_trends": (
        ["snapshots", "trends"],
        """
        SELECT s.*, coalesce(t.trend_value, 0.0) AS trend_value, coalesce(t.trend_ma4, 0.0) AS trend_ma4,
               coalesce(t.trend_change_4w, 0.0) AS trend_change_4w, coalesce(t.trend_spike, 0) AS trend_spike,
               coalesce(t.has_trend_data, 0) AS has_trend_data
        FROM snapshots s ASOF LEFT JOIN (SELECT *, week_start + INTERVAL 7 DAY AS available_at FROM trends) t
          ON s.category = t.category AND s.snapshot_timestamp >= t.available_at
        """,
    ),
    "as_of": (["snapshots"], "SELECT max(ts) AS now, CAST(date_trunc('day', max(ts) - INTERVAL 2 DAY) AS TIMESTAMP) AS cap FROM events"),
    "marked": (
        ["with_trends", "as_of", "markets"],
        """
        SELECT s.*, s.closed_time_ AS closed_time, CASE
                 WHEN s.snapshot_timestamp > s.closed_time_ THEN 'closed_time'
                 WHEN s.price_at_snapshot >= 0.95 OR s.price_at_snapshot <= 0.05 THEN 'settled_price'
                 WHEN s.closed_time_ IS NULL AND s.snapshot_timestamp > i.stop THEN 'inactivity'
                 WHEN s.snapshot_timestamp > (SELECT cap FROM as_of) THEN 'hard_cap' END AS removed_by
        FROM (SELECT w.*, m.closed_time AS closed_time_ FROM with_trends w JOIN markets m ON m.market_id = w.market_id) s
        LEFT JOIN (
          SELECT market_id, least(coalesce(max(CASE WHEN moved THEN snapshot_timestamp END) + INTERVAL 1 DAY,
                                           (SELECT cap FROM as_of)), (SELECT cap FROM as_of)) AS stop
          FROM (SELECT market_id, snapshot_timestamp,
                       abs(price_at_snapshot - lag(price_at_snapshot) OVER (PARTITION BY market_id ORDER BY snapshot_timestamp)) > 0.2 AS moved
                FROM snapshots
                WHERE NOT (price_at_snapshot >= 0.95 OR price_at_snapshot <= 0.05)
                  AND market_id IN (SELECT market_id FROM markets WHERE closed_time IS NULL))
          GROUP BY market_id) i ON i.market_id = s.market_id
        """,
    ),
    "clean": (
        ["marked"],
        """
        SELECT * EXCLUDE (removed_by, closed_time, closed_time_) REPLACE (
                 CASE WHEN split = 'test' AND snapshot_timestamp < (SELECT max(closed_time) FROM markets WHERE split = 'train')
                      THEN 'test_pre_cutoff' ELSE split END AS split)
        FROM marked WHERE removed_by IS NULL
        """,
    ),
    "scored": (
        [],
        f"""
        SELECT l_orderkey AS market_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate AS snapshot_timestamp,
               concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_us(l_shipdate)) AS row_key,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS outcome,
               {r("0.05 + l_discount * 9", 4)} AS price_at_snapshot,
               least(greatest({r("l_discount * 6 + l_quantity / 125", 4)}, 0.001), 0.999) AS p_model_a,
               least(greatest({r("(l_tax * 10 + l_quantity / 50) / 2", 4)}, 0.001), 0.999) AS p_model_b,
               c_mktsegment AS category, 1 + l_orderkey % 500 AS duration_days,
               l_orderkey % 120 + l_linenumber / 10.0::DOUBLE AS days_before_close,
               (l_partkey % 1000) / 1000.0::DOUBLE AS pct_lifetime_elapsed, o_totalprice AS total_volume
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        """,
    ),
    "long_scores": (
        ["scored"],
        """
        SELECT *, 'market' AS model, price_at_snapshot AS p FROM scored UNION ALL
        SELECT *, 'model_a', p_model_a FROM scored UNION ALL SELECT *, 'model_b', p_model_b FROM scored
        """,
    ),
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """`body` preceded by the named views and everything they build on, then `extra` views in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
