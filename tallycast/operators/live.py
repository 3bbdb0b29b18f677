"""Live lookups: warnings, eligibility, sampling, resolution and the track record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles, half_up
from tallycast.functions.timing import days, micros, whole_days
from tallycast.operators import bootstrap as BS
from tallycast.operators import metrics as M

TIME_FEATURES = ["days_before_close", "pct_lifetime_elapsed", "duration_days"]
MIN_PRICES, BURN_IN_DAYS, NEAR_CLOSE_DAYS, LONG_DAYS = 20, 14, 30, 365
MIN_DURATION_DAYS, MIN_VOLUME = 30, 1000.0
SETTLED_HIGH, SETTLED_LOW = 0.95, 0.05
MIN_RESOLVED = 100
# Codes in the order they are raised, the rejecting subset, and the duration buckets
WARNING_CODES = ["few_prices", "no_end_date", "past_end_date", "near_close", "young_market", "settled_price",
                 "long_market", "outside_filters", "no_category"]
REJECTING = ["few_prices", "young_market", "settled_price", "outside_filters", "no_end_date", "past_end_date"]
LIVE_BUCKETS = [("<=90d", 0, 90), ("90-365d", 90, 365), (">365d", 365, None)]


def time_fill(train: DataFrame) -> DataFrame:
    """One row of medians for markets without an end date."""
    names = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in TIME_FEATURES])
    medians = exact_percentiles(train.select(F.inline(names)), ["feature"], "v", [0.5])
    return medians.agg(*[half_up(F.max(F.when(F.col("feature") == c, F.col("value"))), 4).alias(c) for c in TIME_FEATURES])


def fill_time_features(df: DataFrame, fill: DataFrame, now: Column) -> DataFrame:
    """No usable end date: training medians; past its end: no days left; no prices yet: the listed price."""
    no_end = F.col("end_date").isNull() | (F.col("end_date") <= F.col("start_date"))
    med = {c: fill.select(c).scalar() for c in TIME_FEATURES}
    at, start, end = micros(now), micros("start_date"), micros("end_date")
    left = half_up((end - at) / 86_400_000_000.0, 2)
    elapsed = half_up(F.least(F.greatest((at - start) / (end - start).cast("double"), F.lit(0.0)), F.lit(1.0)), 4)
    return df.withColumns({
        "days_before_close": F.when(no_end, med["days_before_close"]).when(F.col("end_date") <= now, 0.0).otherwise(left),
        "pct_lifetime_elapsed": F.when(no_end, med["pct_lifetime_elapsed"]).otherwise(elapsed),
        "duration_days": F.when(no_end, med["duration_days"]).otherwise(whole_days("start_date", "end_date").cast("double")),
        "price_at_snapshot": half_up(F.coalesce("last_price", "listed_price"), 4),
    })


def warning_codes(now: Column) -> Column:
    """Array of codes from start_date, end_date, n_prices, price_at_snapshot, total_volume, category."""
    no_end = F.col("end_date").isNull() | (F.col("end_date") <= F.col("start_date"))
    left = half_up((micros("end_date") - micros(now)) / 86_400_000_000.0, 2)
    duration = F.when(~no_end, whole_days("start_date", "end_date"))
    price = F.col("price_at_snapshot")
    end_code = (
        F.when(no_end, "no_end_date").when(F.col("end_date") <= now, "past_end_date").when(left < NEAR_CLOSE_DAYS, "near_close")
    )
    codes = [
        F.when(F.col("n_prices") < MIN_PRICES, "few_prices"),
        end_code,
        F.when(now < F.col("start_date") + days(BURN_IN_DAYS), "young_market"),
        F.when((price >= SETTLED_HIGH) | (price <= SETTLED_LOW), "settled_price"),
        F.when(duration > LONG_DAYS, "long_market"),
        F.when(F.coalesce(duration < MIN_DURATION_DAYS, F.lit(False)) | (F.col("total_volume") < MIN_VOLUME), "outside_filters"),
        F.when(F.col("category").isNull(), "no_category"),
    ]
    return F.array_compact(F.array(*codes))


def is_rejected(codes: str = "warnings") -> Column:
    return F.arrays_overlap(F.col(codes), F.array(*[F.lit(c) for c in REJECTING]))


def eligible(now: Column, scope_start: str = "2023-01-01") -> Column:
    """Whether a parsed catalogue row may be drawn: binary, open, identified, dated, in scope, liquid, and
    priced strictly between the settled bounds."""
    created, end = F.col("created_at"), F.col("end_date")
    test = (
        (F.col("n_outcomes") == 2) & ~F.coalesce(F.col("closed"), F.lit(False)) & F.col("market_id").isNotNull()
        & (F.col("n_tokens") > 0)
        & (F.col("scope_date") >= F.lit(scope_start).cast("timestamp_ntz"))
        & (F.coalesce(F.col("volume"), F.lit(0.0)) >= MIN_VOLUME)
        & (end > now) & (whole_days("created_at", "end_date") >= MIN_DURATION_DAYS)
        & (created <= now - days(BURN_IN_DAYS))
        & (F.col("yes_price") > SETTLED_LOW) & (F.col("yes_price") < SETTLED_HIGH)
    )
    return F.coalesce(test, F.lit(False))


def draw_order(seed: str, key: str = "market_id") -> list[Column]:
    """A random-looking order that depends on the seed and the ids alone."""
    return [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)]


def daily_sample(pool: DataFrame, sampled: DataFrame, seed: str, n: int) -> DataFrame:
    """First n markets of the draw that were not sampled before and carry no rejecting warning. The limit
    is the feature: a top-n by draw order, kept per task before the final merge."""
    fresh = pool.join(sampled.select("market_id").distinct(), "market_id", "left_anti")
    return fresh.filter(~is_rejected()).orderBy(*draw_order(seed)).limit(n)


def outcome_of(price: Column) -> Column:
    return F.when(price >= SETTLED_HIGH, 1).when(price <= SETTLED_LOW, 0)


def resolve_open(lookups: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Open markets that the catalogue lists as closed get status, outcome and closing time."""
    closed = catalogue.filter(F.col("closed")).select(
        "market_id", F.col("yes_price").alias("final_price"), F.col("closed_time").alias("new_closed_time"),
        F.lit(True).alias("found"),
    )
    joined = lookups.join(closed, "market_id", "left")
    hit = (F.col("resolution_status") == "open") & F.coalesce(F.col("found"), F.lit(False))
    label = outcome_of(F.col("final_price"))
    return joined.withColumns({
        "resolution_status": F.when(hit & label.isNotNull(), "resolved").when(hit, "ambiguous").otherwise(F.col("resolution_status")),
        "outcome": F.when(hit, label).otherwise(F.col("outcome")),
        "closed_time": F.when(hit, F.col("new_closed_time")).otherwise(F.col("closed_time")),
    }).drop("final_price", "new_closed_time", "found")


def first_lookups(lookups: DataFrame) -> DataFrame:
    """First lookup per (source, market) that belongs to a release, by time then id."""
    rest = [c for c in lookups.columns if c not in ("source", "market_id")]
    return (
        lookups.filter(F.col("release").isNotNull())
        .groupBy("source", "market_id")
        .agg(F.min_by(F.struct(*rest), F.struct("ts", "lookup_id")).alias("first"))
        .select("source", "market_id", "first.*")
    )


def status_counts(wide: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("resolution_status")
    return wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("markets"), F.count_if(s == "open").alias("open"),
        F.count_if(s == "resolved").alias("resolved"), F.count_if(s == "ambiguous").alias("ambiguous"),
    )


def scorable(wide: DataFrame, models: list[str]) -> DataFrame:
    ok = (F.col("resolution_status") == "resolved") & F.col("outcome").isNotNull() & F.col("market_price").isNotNull()
    for m in models:
        ok = ok & F.col(m).isNotNull()
    return wide.filter(ok)


def live_bucket(c: str = "duration_days") -> Column:
    """(lower, upper] buckets of the live record."""
    d = F.col(c)
    out = F.lit(None).cast("string")
    for label, lo, hi in reversed(LIVE_BUCKETS):
        out = F.when((d > lo) & (d <= hi if hi else F.lit(True)), label).otherwise(out)
    return out


def length_weight(c: str = "duration_days") -> Column:
    return 1.0 / F.greatest(F.col(c).cast("double") - BURN_IN_DAYS, F.lit(1.0))


def record_metrics(done: DataFrame, keys: list[str], models: list[str], weight: str | None = None,
                   min_resolved: int = MIN_RESOLVED) -> DataFrame:
    """Metrics per group and model, only for groups with enough resolved markets of both classes."""
    size = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("resolved_n"), F.countDistinct("outcome").alias("classes"))
    enough = size.filter((F.col("resolved_n") >= min_resolved) & (F.col("classes") == 2)).select(*keys)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in
                     [("market", "market_price")] + [(m, m) for m in models]])
    keep = [*keys, "market_id", "outcome"] + ([weight] if weight else [])
    long = done.join(enough, keys, "left_semi").select(*keep, F.inline(rows))
    return M.metric_table(long, keys + ["model"], weight=weight)


def vs_market_intervals(done: DataFrame, model: str, n_boot: int, seed: int = 42) -> DataFrame:
    return BS.bootstrap_auc_diff(done, "market_price", model, "market_id", n_boot, seed)
