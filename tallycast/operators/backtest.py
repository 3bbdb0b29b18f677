"""Trade backtest over scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.running import running_sums
from tallycast.operators.bootstrap import bootstrap_ratio

DEFAULT_TAU = 0.02
ALWAYS_NO, ALWAYS_YES = "always_no", "always_yes"


def strategies(df: DataFrame, models: dict[str, str], keep: list[str], price: str = "price_at_snapshot") -> DataFrame:
    """One row per (row, strategy) with its `edge`; the two constant strategies have none."""
    rows = [F.struct(F.lit(m).alias("strategy"), (F.col(c) - F.col(price)).alias("edge")) for m, c in models.items()]
    rows += [F.struct(F.lit(s).alias("strategy"), F.lit(None).cast("double").alias("edge")) for s in (ALWAYS_NO, ALWAYS_YES)]
    return df.select(*keep, F.inline(F.array(*rows)))


def buys_yes() -> Column:
    return F.coalesce(F.col("edge") > 0, F.col("strategy") == ALWAYS_YES)


def trades(
    rows: DataFrame, tau: Column | float = DEFAULT_TAU, cost: Column | float = 0.0, price: str = "price_at_snapshot",
    y: str = "outcome",
) -> DataFrame:
    """Rows that trade, with profit and capital. A YES token costs the price, a NO token one minus it,
    each plus `cost`; the winner pays 1."""
    tau = F.lit(tau) if isinstance(tau, float) else tau
    cost = F.lit(cost) if isinstance(cost, float) else cost
    yes, p, out = buys_yes(), F.col(price), F.col(y)
    return (
        rows.filter(F.col("edge").isNull() | (F.abs("edge") > tau))
        .withColumn("profit", F.when(yes, out - p).otherwise(p - out) - cost)
        .withColumn("capital", F.when(yes, p).otherwise(1 - p) + cost)
    )


def first_trades(
    df: DataFrame, models: dict[str, str], order: list[str], keep: list[str] = (), tau: float = DEFAULT_TAU, cost: float = 0.0,
    price: str = "price_at_snapshot", y: str = "outcome", market: str = "market_id",
) -> DataFrame:
    """The first trade of each market per strategy, as one row per (strategy, market).

    All strategies share the market's order, so one mergeable aggregate with a conditional minimum per
    strategy does it; the rows are not copied per strategy.
    """
    p, out = F.col(price), F.col(y)
    yes_trade = F.struct((out - p - cost).alias("profit"), (p + cost).alias("capital"), *order, *keep)
    no_trade = F.struct((p - out - cost).alias("profit"), (1 - p + cost).alias("capital"), *order, *keep)
    sides = {m: (F.col(c) - p > tau, F.col(c) - p < -tau) for m, c in models.items()}
    sides |= {ALWAYS_NO: (F.lit(False), F.lit(True)), ALWAYS_YES: (F.lit(True), F.lit(False))}
    picks = []
    for name, (yes, no) in sides.items():
        chosen = F.when(yes, yes_trade).when(no, no_trade)
        picks.append(F.min_by(chosen, F.when(yes | no, F.struct(*order))).alias(name))
    per_market = df.groupBy(market).agg(*picks)
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("t")) for n in sides])
    return per_market.select(market, F.inline(rows)).filter(F.col("t").isNotNull()).select("strategy", market, "t.*")


def summary(df: DataFrame, keys: list[str], market: str = "market_id") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.countDistinct(market).alias("markets"),
        F.sum("profit").alias("profit"),
        F.sum("capital").alias("capital"),
        F.avg((F.col("profit") > 0).cast("int")).alias("win_rate"),
    ).withColumn("roi", F.try_divide(F.col("profit"), F.col("capital")))


def sweep(
    rows: DataFrame, keys: list[str], taus: list[float], costs: list[float], price: str = "price_at_snapshot",
    y: str = "outcome", market: str = "market_id",
) -> DataFrame:
    """Summary for every threshold and cost. The cost never decides whether a row trades, and thresholds are
    conditions of one sum per market, so no row is copied: costs are applied to the sums."""
    t = trades(rows, -1.0, price=price, y=y)  # every row, priced
    cells = []
    for i, tau in enumerate(taus):
        on = F.col("edge").isNull() | (F.abs("edge") > tau)
        cells += [F.count_if(on).alias(f"trades_{i}"), F.sum(F.when(on, F.col("profit"))).alias(f"profit_{i}"), F.sum(F.when(on, F.col("capital"))).alias(f"capital_{i}")]
        cells += [F.count_if(on & (F.col("profit") - c > 0)).alias(f"wins_{i}_{k}") for k, c in enumerate(costs)]
    names = [n for i in range(len(taus)) for n in (f"trades_{i}", f"profit_{i}", f"capital_{i}", *(f"wins_{i}_{k}" for k in range(len(costs))))]
    per_market = t.groupBy(*keys, market).agg(*cells)
    sums = per_market.groupBy(*keys).agg(*[F.count_if(F.col(f"trades_{i}") > 0).alias(f"markets_{i}") for i in range(len(taus))], *[F.sum(n).alias(n) for n in names])
    out = []
    for i, tau in enumerate(taus):
        n = F.col(f"trades_{i}")
        out += [F.struct(
            F.lit(tau).alias("tau"), F.lit(c).alias("cost"), n.alias("trades"), F.col(f"markets_{i}").alias("markets"), (F.col(f"profit_{i}") - c * n).alias("profit"),
            (F.col(f"capital_{i}") + c * n).alias("capital"), F.try_divide(F.col(f"wins_{i}_{k}"), n).alias("win_rate")) for k, c in enumerate(costs)]
    priced = sums.select(*keys, F.inline(F.array(*out))).filter(F.col("trades") > 0)
    return priced.withColumn("roi", F.try_divide(F.col("profit"), F.col("capital")))


def first_trade_sweep(
    df: DataFrame, models: dict[str, str], order: list[str], taus: list[float], costs: list[float], n_boot: int, seed: int = 42,
    market: str = "market_id",
) -> DataFrame:
    """ROI of one trade per market for every strategy, threshold and cost, with an interval over resampled markets.
    The constant strategies have one row a cost, under a NULL threshold."""
    per_tau = [first_trades(df, models, order, tau=t, market=market).withColumn("tau", F.lit(t)) for t in taus]
    cells = {f"{m}|{i}": (m, t) for m in models for i, t in enumerate(taus)} | {s: (s, None) for s in (ALWAYS_NO, ALWAYS_YES)}
    rows = reduce(DataFrame.unionByName, per_tau)
    rows = rows.filter(F.col("strategy").isin(*models) | (F.col("tau") == taus[0]))  # constant strategies once
    columns = []
    for k, (name, tau) in enumerate(cells.values()):
        here = (F.col("strategy") == name) & (F.col("tau") == tau if tau is not None else F.lit(True))
        for j, c in enumerate(costs):
            columns += [F.coalesce(F.sum(F.when(here, F.col("profit") - c)), F.lit(0.0)).alias(f"p_{k}_{j}"), F.coalesce(F.sum(F.when(here, F.col("capital") + c)), F.lit(0.0)).alias(f"c_{k}_{j}")]
    wide = rows.groupBy(market).agg(*columns)
    ratios = {f"{k}_{j}": (f"p_{k}_{j}", f"c_{k}_{j}") for k in range(len(cells)) for j in range(len(costs))}
    names = F.array(*[F.struct(F.lit(f"{k}_{j}").alias("measure"), F.lit(m).alias("strategy"), F.lit(t).cast("double").alias("tau"), F.lit(c).alias("cost"))
                      for k, (m, t) in enumerate(cells.values()) for j, c in enumerate(costs)])
    labels = df.sparkSession.range(1).select(F.inline(names))
    return bootstrap_ratio(wide, market, ratios, n_boot, seed).join(labels, "measure").select("strategy", "tau", "cost", F.col("point").alias("roi"), "ci_lo", "ci_hi")


def roi_interval(df: DataFrame, n_boot: int, seed: int = 42, market: str = "market_id") -> DataFrame:
    """ROI of one strategy with an interval over resampled markets."""
    per_market = df.groupBy(market).agg(F.sum("profit").alias("profit"), F.sum("capital").alias("capital"))
    return bootstrap_ratio(per_market, market, {"roi": ("profit", "capital")}, n_boot, seed)


def cumulative_profit(df: DataFrame, keys: list[str], ts: str = "snapshot_timestamp") -> DataFrame:
    """Profit per timestamp and its running total; rows collapse per timestamp before any ordering."""
    daily = df.groupBy(*keys, ts).agg(F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("trades"))
    placed = daily.withColumn("lvl", F.date_trunc("month", F.col(ts)))
    return running_sums(placed, keys, ["lvl"], [ts], {"cum_profit": F.col("profit"), "cum_trades": F.col("trades")})


def nearest_rows(
    df: DataFrame, targets: list[int], position: Column, ts: list[str], keep: list[str], tolerance: float | None = None,
    market: str = "market_id", name: str = "horizon",
) -> DataFrame:
    """Per market and target the row whose `position` lies closest, earliest on equal distance. With a tolerance a row
    is looked at for the targets within it only; without one, a market's rows are gone over once, for all targets."""
    if tolerance is None:
        rows = df.select(market, *keep, *[c for c in ts if c not in keep], position.alias("__position"))
        distances = [F.abs(F.col("__position") - t) for t in targets]
        payload = F.struct(*keep, F.col("__position").alias("position"))
        per_market = rows.groupBy(market).agg(*[F.min_by(payload, F.struct(d, *ts)).alias(f"b{i}") for i, d in enumerate(distances)])
        each = F.array(*[F.struct(F.lit(t).alias(name), F.col(f"b{i}").alias("b")) for i, t in enumerate(targets)])
        found = per_market.select(market, F.inline(each)).select(market, name, "b.*")
        return found.withColumn("distance", F.abs(F.col("position") - F.col(name)))
    every = F.array(*[F.lit(t) for t in targets])
    near = F.filter(every, lambda t: F.abs(position - t) <= tolerance)
    wide = df.select(market, *keep, *[c for c in ts if c not in keep], position.alias("position"),
                     F.explode(near).alias(name))
    dist = F.abs(F.col("position") - F.col(name))
    payload = F.struct(*keep, "position", dist.alias("distance"))
    best = wide.groupBy(market, name).agg(F.min_by(payload, F.struct(dist, *ts)).alias("b")).select(market, name, "b.*")
    return best.filter(F.col("distance") <= tolerance)
