"""Backtest queries over the scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up
from tallycast.operators import backtest as B
from tallycast.plans.metric_queries import MODELS, rnd
from tallycast.plans.metric_queries import LOSS_BOOTS, ratio_boot_sql
from tallycast.plans.oracle_views import r, with_views
from tallycast.plans.registry import query
from tallycast.sources import views as V

KEEP = ["market_id", "snapshot_timestamp", "row_key", "outcome", "price_at_snapshot", "category"]
STRATEGY_SQL = """SELECT *, 'model_a' AS strategy, p_model_a - price_at_snapshot AS edge FROM scored UNION ALL
    SELECT *, 'model_b', p_model_b - price_at_snapshot FROM scored UNION ALL
    SELECT *, 'always_no', NULL FROM scored UNION ALL SELECT *, 'always_yes', NULL FROM scored"""
YES = "coalesce(edge > 0, strategy = 'always_yes')"


def trade_sql(tau: str = "0.02", cost: str = "0.0", source: str = "strategies") -> str:
    return f"""SELECT *, CASE WHEN {YES} THEN outcome - price_at_snapshot ELSE price_at_snapshot - outcome END - {cost}::DOUBLE AS profit,
        CASE WHEN {YES} THEN price_at_snapshot ELSE 1 - price_at_snapshot END + {cost}::DOUBLE AS capital
        FROM {source} WHERE edge IS NULL OR abs(edge) > {tau}::DOUBLE"""


def summary_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, count(*) AS trades, count(DISTINCT market_id) AS markets, {r('sum(profit)', 4)} AS profit, {r('sum(capital)', 4)} AS capital,
        {r('avg(CASE WHEN profit > 0 THEN 1 ELSE 0 END)', 6)} AS win_rate, {r('sum(profit) / nullif(sum(capital), 0)', 6)} AS roi FROM {source} GROUP BY ALL"""


FIRST_SQL = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY strategy, market_id ORDER BY snapshot_timestamp, row_key) AS rn FROM trades) WHERE rn = 1"""


def strategy_rows(spark, d, *keep):
    return B.strategies(V.scored(spark, d), MODELS, [*KEEP, *keep])


def tidy(summary):
    return rnd(rnd(summary, "profit", "capital", digits=4), "win_rate", "roi")


def summarised(df, keys):
    return tidy(B.summary(df, keys))


@query("t_per_snapshot", with_views(summary_sql("strategy", "trades"), "scored", extra={"strategies": STRATEGY_SQL, "trades": trade_sql()}))
def t_per_snapshot(spark, d):
    return summarised(B.trades(strategy_rows(spark, d)), ["strategy"])


@query(
    "t_one_per_market",
    with_views(summary_sql("strategy", "firsts"), "scored", extra={"strategies": STRATEGY_SQL, "trades": trade_sql(), "firsts": FIRST_SQL}),
)
def t_one_per_market(spark, d):
    firsts = B.first_trades(V.scored(spark, d), MODELS, ["snapshot_timestamp", "row_key"])
    return summarised(firsts, ["strategy"])


@query(
    "t_first_trades",
    with_views("SELECT strategy, market_id, snapshot_timestamp, row_key FROM firsts", "scored",
               extra={"strategies": STRATEGY_SQL, "trades": trade_sql(), "firsts": FIRST_SQL}),
)
def t_first_trades(spark, d):
    firsts = B.first_trades(V.scored(spark, d), MODELS, ["snapshot_timestamp", "row_key"])
    return firsts.select("strategy", "market_id", "snapshot_timestamp", "row_key")


GRID_SQL = "SELECT * FROM strategies, (SELECT unnest([0.02, 0.05, 0.1])::DOUBLE AS tau), (SELECT unnest([0.0, 0.01, 0.02])::DOUBLE AS cost)"


@query(
    "t_tau_cost_sweep",
    with_views(summary_sql("strategy, tau, cost", "trades"), "scored",
               extra={"strategies": STRATEGY_SQL, "grid": GRID_SQL, "trades": trade_sql("tau", "cost", "grid")}),
)
def t_tau_cost_sweep(spark, d):
    return tidy(B.sweep(strategy_rows(spark, d), ["strategy"], TAUS, COSTS))


@query(
    "t_roi_interval",
    ratio_boot_sql("SELECT market_id, sum(profit) AS profit, sum(capital) AS capital FROM trades WHERE strategy = 'model_a' GROUP BY market_id",
                   {"roi": ("profit", "capital")}, LOSS_BOOTS, "scored", extra={"strategies": STRATEGY_SQL, "trades": trade_sql()}),
)
def t_roi_interval(spark, d):
    t = B.trades(B.strategies(V.scored(spark, d), {"model_a": "p_model_a"}, KEEP)).filter("strategy = 'model_a'")
    return rnd(B.roi_interval(t, LOSS_BOOTS), "ci_lo", "ci_hi", "point")


TAUS, COSTS = [0.02, 0.05, 0.1], [0.0, 0.01, 0.02]
SWEEP_CELLS = [(m, t) for m in MODELS for t in TAUS] + [("always_no", None), ("always_yes", None)]
SWEEP_MARKETS = "SELECT market_id, " + ", ".join(
    f"""coalesce(sum({v}) FILTER (strategy = '{m}' AND tau = {t or TAUS[0]}::DOUBLE), 0.0::DOUBLE) AS {n}_{k}_{j}"""
    for k, (m, t) in enumerate(SWEEP_CELLS) for j, c in enumerate(COSTS) for n, v in (("p", f"profit - {c}::DOUBLE"), ("c", f"capital + {c}::DOUBLE"))) + " FROM firsts GROUP BY market_id"
SWEEP_NAMES = ", ".join(f"('{k}_{j}', '{m}', {f'{t}::DOUBLE' if t else 'NULL::DOUBLE'}, {c}::DOUBLE)" for k, (m, t) in enumerate(SWEEP_CELLS) for j, c in enumerate(COSTS))
SWEEP_SQL = ratio_boot_sql(SWEEP_MARKETS, {f"{k}_{j}": (f"p_{k}_{j}", f"c_{k}_{j}") for k in range(len(SWEEP_CELLS)) for j in range(len(COSTS))}, LOSS_BOOTS, "scored", extra={
    "strategies": STRATEGY_SQL, "grid": "SELECT * FROM strategies, (SELECT unnest([0.02, 0.05, 0.1])::DOUBLE AS tau)", "trades": trade_sql("tau", "0.0", "grid"),
    "firsts": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY strategy, tau, market_id ORDER BY snapshot_timestamp, row_key) AS rn FROM trades) WHERE rn = 1"})


@query("t_first_trade_sweep", f"SELECT strategy, tau, cost, point AS roi, ci_lo, ci_hi FROM ({SWEEP_SQL}) JOIN (VALUES {SWEEP_NAMES}) n(measure, strategy, tau, cost) USING (measure)")
def t_first_trade_sweep(spark, d):
    out = B.first_trade_sweep(V.scored(spark, d), MODELS, ["snapshot_timestamp", "row_key"], TAUS, COSTS, LOSS_BOOTS)
    return rnd(out, "roi", "ci_lo", "ci_hi")


HORIZONS = list(range(7, 91))
NEAR_SQL = """SELECT * FROM (SELECT s.*, h.horizon, abs(duration_days - days_before_close - h.horizon) AS distance,
      row_number() OVER (PARTITION BY market_id, h.horizon ORDER BY abs(duration_days - days_before_close - h.horizon), snapshot_timestamp, row_key) AS rn
    FROM scored s, (SELECT unnest(range({lo}, {hi}))::INTEGER AS horizon) h) WHERE rn = 1 AND distance <= 2.0"""


def horizon_rows(spark, d, horizons):
    return B.nearest_rows(
        V.scored(spark, d), horizons, F.col("duration_days") - F.col("days_before_close"), ["snapshot_timestamp", "row_key"],
        ["snapshot_timestamp", "row_key", "outcome", "price_at_snapshot", "p_model_a", "p_model_b", "category"], 2.0)


@query("c_horizon_rows", with_views("SELECT market_id, horizon, row_key FROM near", "scored", extra={"near": NEAR_SQL.format(lo=20, hi=21)}))
def c_horizon_rows(spark, d):
    return horizon_rows(spark, d, [20]).select("market_id", "horizon", "row_key")


HORIZON_STRATEGIES = """SELECT *, 'model_a' AS strategy, p_model_a - price_at_snapshot AS edge FROM near UNION ALL
    SELECT *, 'model_b', p_model_b - price_at_snapshot FROM near"""


@query(
    "t_horizon_sweep",
    with_views(summary_sql("strategy, horizon", "trades"), "scored",
               extra={"near": NEAR_SQL.format(lo=7, hi=91), "strategies": HORIZON_STRATEGIES, "trades": trade_sql()}),
)
def t_horizon_sweep(spark, d):
    near = horizon_rows(spark, d, HORIZONS)
    rows = B.strategies(near, MODELS, ["market_id", "horizon", "outcome", "price_at_snapshot"]).filter("edge IS NOT NULL")
    return summarised(B.trades(rows), ["strategy", "horizon"])


@query(
    "t_min_edge_sweep",
    with_views(summary_sql("strategy, tau", "trades"), "scored",
               extra={"near": NEAR_SQL.format(lo=20, hi=21), "strategies": HORIZON_STRATEGIES,
                      "grid": "SELECT * FROM strategies, (SELECT unnest(range(0, 16)) * 0.02::DOUBLE AS tau)", "trades": trade_sql("tau", "0.0", "grid")}),
)
def t_min_edge_sweep(spark, d):
    rows = B.strategies(horizon_rows(spark, d, [20]), MODELS, ["market_id", "outcome", "price_at_snapshot"]).filter("edge IS NOT NULL")
    return tidy(B.sweep(rows, ["strategy"], [k * 0.02 for k in range(16)], [0.0]).drop("cost"))


@query(
    "t_profit_by_category",
    with_views(summary_sql("strategy, category", "trades"), "scored", extra={"strategies": STRATEGY_SQL, "trades": trade_sql()}),
)
def t_profit_by_category(spark, d):
    return summarised(B.trades(strategy_rows(spark, d)), ["strategy", "category"])


@query(
    "t_cumulative_profit",
    with_views(
        f"""SELECT strategy, snapshot_timestamp, trades, {r('profit', 4)} AS profit, {r('sum(profit) OVER w', 4)} AS cum_profit,
                   CAST(sum(trades) OVER w AS BIGINT) AS cum_trades
            FROM (SELECT strategy, snapshot_timestamp, count(*) AS trades, sum(profit) AS profit FROM trades GROUP BY ALL)
            WINDOW w AS (PARTITION BY strategy ORDER BY snapshot_timestamp)""", "scored", extra={"strategies": STRATEGY_SQL, "trades": trade_sql()}),
)
def t_cumulative_profit(spark, d):
    return rnd(B.cumulative_profit(B.trades(strategy_rows(spark, d)), ["strategy"]), "profit", "cum_profit", digits=4)


@query(
    "d_edge_stats",
    with_views(
        f"""SELECT strategy, count(*) AS n, count(*) FILTER (abs(edge) > 0.02) AS trades, {r('100.0 * count(*) FILTER (abs(edge) > 0.02) / count(*)', 4)} AS pct_traded,
                   {r('avg(edge)', 6)} AS edge_mean, {r('stddev_pop(edge)', 6)} AS edge_std, {r('avg(abs(edge))', 6)} AS edge_abs_mean
            FROM strategies WHERE edge IS NOT NULL GROUP BY strategy""", "scored", extra={"strategies": STRATEGY_SQL}),
)
def d_edge_stats(spark, d):
    rows = strategy_rows(spark, d).filter("edge IS NOT NULL")
    traded = F.count_if(F.abs("edge") > 0.02)
    out = rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), traded.alias("trades"), half_up(100.0 * traded / F.count(F.lit(1)), 4).alias("pct_traded"),
        F.avg("edge").alias("edge_mean"), F.stddev_pop("edge").alias("edge_std"), F.avg(F.abs("edge")).alias("edge_abs_mean"))
    return rnd(out, "edge_mean", "edge_std", "edge_abs_mean")
