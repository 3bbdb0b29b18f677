"""Quality gates. A gate returns a row for each check and id that fails it; a job fails on any issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up
from tallycast.functions.timing import DAY, HOUR, SECOND, days, div, micros, whole_days
from tallycast.operators.leakage import is_settled, split_cutoff
from tallycast.operators.live import SETTLED_HIGH, SETTLED_LOW, outcome_of
from pyspark.sql import Window as W

# Metadata columns that must be filled, and prices that only a repair script ever wrote
REQUIRED_META = ["market_id", "clob_token_id", "question", "start_date", "end_date", "duration_days",
                 "total_volume", "yes_final_price", "outcome", "split"]
PLACEHOLDER_PRICES = [0.05, 0.95]
SOURCE_FIELDS = ["clob_token_id", "question", "start_date", "end_date", "duration_days", "total_volume",
                 "yes_final_price", "outcome"]


class GateFailed(Exception):
    pass


def gate_table(df: DataFrame, issues: dict[str, Column], notes: dict[str, Column] | None = None, key: str = "market_id") -> DataFrame:
    """(check_name, severity, market_id, n): every id that fails a test, with its failing rows. One pass: the tests
    become an array of names per row, so only failing rows reach the shuffle."""
    tests = [(n, "issue", t) for n, t in issues.items()] + [(n, "note", t) for n, t in (notes or {}).items()]
    names = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(
        F.lit(n).alias("check_name"), F.lit(s).alias("severity"))) for n, s, t in tests]))
    failing = df.select(F.col(key).cast("string").alias("market_id"), F.inline(names))
    return failing.groupBy("check_name", "severity", "market_id").agg(F.count(F.lit(1)).alias("n"))


def gate_counts(gate: DataFrame) -> DataFrame:
    """Failing rows and ids of each check that found any."""
    return gate.groupBy("check_name", "severity").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("markets"), F.min("market_id").alias("first_id"))


def require_clean(gate: DataFrame) -> None:
    """Raise if a gate reports an issue."""
    bad = gate_counts(gate.filter("severity = 'issue'")).orderBy("check_name").collect()
    if bad:
        raise GateFailed("; ".join(f"{r.check_name}: {r.n} (e.g. {r.first_id})" for r in bad))


def check_meta(meta: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED_META if c not in meta.columns]
    if missing:
        raise GateFailed(f"missing columns: {missing}")
    copies = meta.groupBy("market_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = meta.join(copies, "market_id", "left")
    label = outcome_of(F.col("yes_final_price"))
    tests = {"duplicate_market_id": F.col("copies") > 1}
    for c in REQUIRED_META:
        tests[f"empty_{c}"] = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    tests |= {
        "placeholder_price": F.col("yes_final_price").isin(*PLACEHOLDER_PRICES),
        "outcome_vs_price": label.isNull() | F.col("outcome").isNull() | (label != F.col("outcome")),
        "bad_dates": F.col("start_date").isNull() | F.col("end_date").isNull(),
        "end_not_after_start": F.col("end_date") <= F.col("start_date"),
        "duration_mismatch": whole_days("start_date", "end_date") != F.col("duration_days"),
        "bad_split": ~F.coalesce(F.col("split").isin("train", "test"), F.lit(False)),
    }
    return gate_table(rows, tests)


def differs(c: str, a: Column, b: Column) -> Column:
    """Field comparison: dates within a second, numbers within 1e-6, anything else exactly."""
    if c in ("start_date", "end_date"):
        return F.abs(micros(a) - micros(b)) > SECOND
    if c in ("total_volume", "yes_final_price"):
        return F.abs(a - b) > 1e-6
    return ~a.eqNullSafe(b)


def check_against_source(meta: DataFrame, evidence: DataFrame, fields: list[str] = SOURCE_FIELDS) -> DataFrame:
    """(problem, market_id) for fields that differ from the source evidence, and markets without evidence."""
    fresh = evidence.select("market_id", *[F.col(c).alias(f"src_{c}") for c in fields], F.lit(True).alias("found"))
    joined = meta.join(fresh, "market_id", "left")
    found = F.col("found").isNotNull()
    tests = [F.when(~found, F.lit("no_evidence"))]
    tests += [F.when(found & differs(c, F.col(c), F.col(f"src_{c}")), F.lit(f"{c}_differs")) for c in fields]
    return joined.select("market_id", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def coverage(found: DataFrame, meta: DataFrame, fetched_at: Column, first_day: str) -> DataFrame:
    """Qualifying markets that the metadata lacks, by reason, and metadata that the route did not return."""
    missing = found.join(meta.select("market_id"), "market_id", "left_anti")
    out_of_scope = F.col("scope_date").isNull() | (F.col("scope_date") < F.lit(first_day).cast("timestamp_ntz"))
    reason = F.when(out_of_scope, "out_of_scope").when(F.col("closed_time") > fetched_at, "new_since_fetch").otherwise("missed")
    extra = meta.join(found.select("market_id"), "market_id", "left_anti").select("market_id", F.lit("not_returned").alias("reason"))
    return missing.select("market_id", reason.alias("reason")).unionByName(extra)


def check_raw(snapshots: DataFrame, meta: DataFrame, interval_hours: int = 12, burn_in_days: int = 14, window_days=(7, 14)) -> DataFrame:
    """Structure, time window, agreement with metadata and value ranges of a raw build."""
    m = meta.select(
        "market_id", F.lit(True).alias("in_meta"), "start_date", "end_date", "closed_time",
        *[F.col(c).alias(f"meta_{c}") for c in ("outcome", "split", "category")])
    by_time = W.partitionBy("market_id").orderBy("snapshot_timestamp")
    rows = snapshots.withColumn("gap", micros("snapshot_timestamp") - F.lag(micros("snapshot_timestamp")).over(by_time)).join(m, "market_id", "left")
    ts, sec = micros("snapshot_timestamp"), SECOND
    issues = {
        "duplicate_row": F.col("gap") == 0,
        "bad_gap": F.col("gap") != interval_hours * HOUR,
        "not_in_meta": F.col("in_meta").isNull(),
        "before_burn_in": ts < micros("start_date") + burn_in_days * DAY - sec,
        "after_end": ts > micros("end_date") + sec,
        "after_closed_time": ts > micros("closed_time") + sec,
        "outcome_vs_meta": ~F.col("outcome").eqNullSafe(F.col("meta_outcome")),
        "split_vs_meta": ~F.col("split").eqNullSafe(F.col("meta_split")),
        "category_vs_meta": F.col("category").isNotNull() & ~F.col("category").eqNullSafe(F.col("meta_category")),
        "negative_days_left": F.col("days_before_close") < -0.01,
        "elapsed_out_of_range": (F.col("pct_lifetime_elapsed") < 0) | (F.col("pct_lifetime_elapsed") > 1),
    }
    notes = {
        "category_blank": F.col("category").isNull(),
        "price_out_of_range": (F.col("price_at_snapshot") < 0) | (F.col("price_at_snapshot") > 1),
    }
    for d in window_days:
        lo, mid, hi, rng = (F.col(f"price_{s}_{d}d") for s in ("min", "mean", "max", "range"))
        issues[f"mean_outside_{d}d"] = (lo > mid + 1e-4) | (mid > hi + 1e-4)
        issues[f"range_mismatch_{d}d"] = F.abs(rng - (hi - lo)) > 2e-4
        notes[f"empty_window_{d}d"] = mid.isNull()
    return gate_table(rows, issues, notes)


def compare_builds(old: DataFrame, new: DataFrame, closed_times: DataFrame, features: list[str], new_window_days: float = 14.5) -> DataFrame:
    """Old against new build: differing values and one-sided rows, minus what a changed end date, the close
    or the extended last days explain."""
    keys = ["market_id", "snapshot_timestamp"]
    cols = list(dict.fromkeys(["days_before_close", *features]))
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("is_old"))
    b = new.join(old.select("market_id").distinct(), "market_id", "left_semi").select(
        *keys, *[F.col(c).alias(f"new_{c}") for c in cols], F.lit(True).alias("is_new"))
    j = a.join(b, keys, "full_outer")
    both = F.col("is_old").isNotNull() & F.col("is_new").isNotNull()
    shift = F.when(both, F.col("new_days_before_close") - F.col("old_days_before_close"))
    moved = j.filter(F.abs(shift) > 1e-6).groupBy("market_id").agg((F.max(shift) - F.min(shift)).alias("spread"))
    rows = j.join(moved, "market_id", "left").join(closed_times.select("market_id", "closed_time"), "market_id", "left")
    dated = F.coalesce(F.abs("spread") <= 0.02, F.lit(False))
    old_only, new_only = F.col("is_new").isNull(), F.col("is_old").isNull()
    after_close = F.coalesce(F.col("snapshot_timestamp") > F.col("closed_time"), F.lit(False))
    last_days = F.coalesce(F.col("new_days_before_close") <= new_window_days, F.lit(False))
    issues = {
        "shift_not_constant": both & (F.abs("spread") > 0.02) & (F.abs(shift) > 1e-6),
        "old_only_unexplained": old_only & ~after_close & ~dated,
        "new_only_unexplained": new_only & ~last_days & ~dated,
    }
    notes = {
        "in_both": both, "old_only_after_close": old_only & after_close, "new_only_last_days": new_only & last_days,
        "old_only_end_changed": old_only & ~after_close & dated, "new_only_end_changed": new_only & ~last_days & dated,
    }
    for c in features:
        if c == "days_before_close":
            continue
        x, y = F.col(f"old_{c}"), F.col(f"new_{c}")
        tol = 1.01e-4 if c == "pct_lifetime_elapsed" else 1e-6
        differ = both & ((x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol + 1e-5 * F.abs(y), F.lit(False)))
        if c in ("pct_lifetime_elapsed", "duration_days"):
            differ = differ & ~dated
        issues[f"{c}_differs"] = differ
    return gate_table(rows, issues, notes)


def row_digest(columns: list[str]) -> Column:
    """60 bits of the MD5 of the row's values as text, a NULL told from any text; any SQL engine can repeat it."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def market_digests(df: DataFrame, exclude: list[str] = (), name: str = "digest", also: dict[str, list[str]] | None = None) -> DataFrame:
    """Per market: row count and two 30-bit sums of row digests; independent of row order. `also` adds digests
    with other columns left out, in the same pass."""
    def digest(skip: list[str]):
        h = row_digest([c for c in sorted(df.columns) if c not in skip])
        low, high = h.bitwiseAND(F.lit((1 << 30) - 1)), F.shiftright(h, 30)
        return F.struct(F.count(F.lit(1)).alias("n"), F.sum(low.cast("bigint")).alias("lo"), F.sum(high.cast("bigint")).alias("hi"))

    wanted = {name: list(exclude), **(also or {})}
    return df.groupBy("market_id").agg(*[digest(skip).alias(n) for n, skip in wanted.items()])


def table_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n, digest): row count and the sum of row digests modulo 2^64."""
    total = F.coalesce(F.sum(row_digest(keys).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    mod = F.lit("18446744073709551616").cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.pmod(total, mod).cast("string").alias("digest"))


def compare_with_parent(new: DataFrame, parent: DataFrame, built: DataFrame) -> DataFrame:
    """Per market: gone, added without being built, added, changed, recategorised, same."""
    def digests(df, side):
        return market_digests(df, ["split"], f"{side}_full", {f"{side}_bare": ["split", "category"]})

    j = digests(new, "new").join(digests(parent, "old"), "market_id", "full_outer").join(
        built.select("market_id").distinct().withColumn("built", F.lit(True)), "market_id", "left")
    state = (
        F.when(F.col("new_full").isNull(), "gone")
        .when(F.col("old_full").isNull() & F.col("built").isNull(), "added_not_built")
        .when(F.col("old_full").isNull(), "added")
        .when(F.col("new_bare") != F.col("old_bare"), "changed")
        .when(F.col("new_full") != F.col("old_full"), "recategorised")
        .otherwise("same")
    )
    return j.select("market_id", state.alias("state"))


def check_clean(clean: DataFrame, meta: DataFrame, features: list[str]) -> DataFrame:
    """Settled rows, NULL features, agreement with metadata, and the time order of the splits."""
    m = meta.select("market_id", F.col("outcome").alias("meta_outcome"), F.col("category").alias("meta_category"), F.lit(True).alias("in_meta"))
    cutoff = split_cutoff(meta).select("cutoff").scalar()
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
    rows = clean.join(m, "market_id", "left").withColumn("cutoff", cutoff)
    late = F.col("snapshot_timestamp") >= F.col("cutoff")
    s = F.col("split")
    return gate_table(rows, {
        "settled_price": is_settled(),
        "null_feature": any_null,
        "outcome_vs_meta": ~F.col("outcome").eqNullSafe(F.col("meta_outcome")),
        "category_vs_meta": ~F.col("category").eqNullSafe(F.col("meta_category")),
        "train_after_cutoff": (s == "train") & late,
        "test_before_cutoff": (s == "test") & ~late,
        "pre_cutoff_after_cutoff": (s == "test_pre_cutoff") & late,
    })


def parity(stored: DataFrame, recomputed: DataFrame, keys: list[str], features: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per feature: rows off by more than the tolerance or without a recomputed value, and the largest difference."""
    again = recomputed.select(*keys, *[F.col(c).alias(f"again_{c}") for c in features])
    joined = stored.join(again, keys, "left")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(c) - F.col(f"again_{c}")).cast("double").alias("diff")) for c in features])
    long = joined.select(F.inline(pairs))
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("diff").isNull()).alias("absent"),
        F.count_if(F.col("diff") > tolerance).alias("off"), F.max("diff").alias("max_diff"))


RECOMPUTED = ("mean", "min", "max", "range", "change")


def recompute_windows(snapshots: DataFrame, prices: DataFrame, window_days: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Window features of each snapshot straight from the raw prices, a second path next to the slot sums of the build.

    A snapshot looks up (market, day) for each day that its longest window touches, so a market with a third of all prices
    spreads over its days; sums are combined before they are shuffled. Work is snapshots x prices in a window, so a
    large table is checked on a sample of its snapshots. Snapshots without a price in the longest window have no row."""
    longest = max(window_days)
    at = snapshots.select("market_id", "snapshot_timestamp", micros("snapshot_timestamp").alias("until_us"))
    day = div(F.col("until_us"), DAY)
    asked = at.withColumn("day", F.explode(F.sequence(day - longest, day)))
    seen = prices.select("market_id", micros("ts").alias("at_us"), "event_id", "price").withColumn("day", div(F.col("at_us"), DAY))
    met = asked.join(seen, ["market_id", "day"]).filter("at_us <= until_us").filter(F.col("at_us") >= F.col("until_us") - longest * DAY)
    when, sums = F.struct("at_us", "event_id"), []
    for d in window_days:
        inside = F.col("at_us") >= F.col("until_us") - d * DAY
        price = F.when(inside, F.col("price"))
        sums += [F.count(price).alias(f"n_{d}"), F.avg(price).alias(f"mean_{d}"), F.min(price).alias(f"min_{d}"), F.max(price).alias(f"max_{d}"),
                 (F.max_by(price, F.when(inside, when)) - F.min_by(price, F.when(inside, when))).alias(f"change_{d}")]
    rows = met.groupBy("market_id", "snapshot_timestamp").agg(*sums).withColumns({f"range_{d}": F.col(f"max_{d}") - F.col(f"min_{d}") for d in window_days})
    return rows.select("market_id", "snapshot_timestamp", *[
        F.when(F.col(f"n_{d}") >= 2, half_up(F.col(f"{s}_{d}"), 4)).alias(f"price_{s}_{d}d") for d in window_days for s in RECOMPUTED])


def refresh_report(before: DataFrame, after: DataFrame, fields: list[str] = SOURCE_FIELDS) -> DataFrame:
    """Changed markets per field, flipped outcomes, dropped markets."""
    new = after.select("market_id", *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("kept"))
    j = before.join(new, "market_id", "left")
    kept = F.col("kept").isNotNull()
    tests = {f"changed_{c}": kept & ~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in fields}
    return gate_table(j, {}, {**tests, "flipped_outcome": kept & (F.col("outcome") != F.col("new_outcome")), "dropped": ~kept})


def split_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: markets that change split, cutoff before and after, whether it moved back."""
    j = old.select("market_id", F.col("split").alias("old_split")).join(new.select("market_id", "split"), "market_id")
    moved = j.agg(F.count(F.lit(1)).alias("markets"), F.count_if(F.col("old_split") != F.col("split")).alias("moved"))
    before, after = split_cutoff(old).select("cutoff").scalar(), split_cutoff(new).select("cutoff").scalar()
    return moved.withColumn("cutoff_before", before).withColumn("cutoff_after", after).withColumn(
        "moved_back", F.col("cutoff_after") < F.col("cutoff_before"))


def settings_differ(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Settings (name, value) on which the stored build and the wanted one disagree; appending needs none."""
    s, w = stored.select("name", F.col("value").alias("stored")), wanted.select("name", F.col("value").alias("wanted"))
    return s.join(w, "name", "full_outer").filter(~F.col("stored").eqNullSafe(F.col("wanted")))


def mixed_versions(df: DataFrame, file: Column) -> DataFrame:
    """Files that hold more than one dataset version."""
    return df.groupBy(file.alias("file")).agg(F.countDistinct("dataset_version").alias("versions")).filter("versions > 1")
