"""Quality gates, release comparison and live-record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up
from tallycast.functions.timing import days, micros
from tallycast.operators import bootstrap as BS
from tallycast.operators import live as L
from tallycast.operators import metrics as M
from tallycast.operators import quality as Q
from tallycast.operators import release as RL
from tallycast.operators.snapshots import rolling_columns
from tallycast.plans.feature_queries import newest_event, stored_clean
from tallycast.plans.metric_queries import AUC_BOOTS, LOSS_BOOTS, METRICS, auc_boot_sql, rnd
from tallycast.plans.oracle_views import r, with_views
from tallycast.plans.registry import query
from tallycast.plans.source_queries import CATALOGUE_SQL, META_SQL, REASON_SQL, catalogue
from tallycast.plans.sql_parts import metric_sql, rounded
from tallycast.session import cut
from tallycast.sources import catalogue as C
from tallycast.sources import views as V

FAULTY_META = """SELECT market_id, clob_token_id, CASE WHEN market_id % 11 = 0 THEN ' ' ELSE question END AS question, start_date,
    CASE WHEN market_id % 13 = 0 THEN NULL WHEN market_id % 17 = 0 THEN start_date ELSE end_date END AS end_date,
    CASE WHEN market_id % 19 = 0 THEN duration_days + 1 ELSE duration_days END AS duration_days, total_volume,
    CASE WHEN market_id % 7 = 0 THEN 0.95 WHEN market_id % 5 = 0 THEN 0.99 WHEN market_id % 5 = 1 THEN 0.01 ELSE yes_final_price END AS yes_final_price,
    outcome, CASE WHEN market_id % 23 = 0 THEN 'val' ELSE split END AS split FROM {m}
    UNION ALL SELECT market_id, clob_token_id, question, start_date, end_date, duration_days, total_volume, yes_final_price, outcome, split FROM {m} WHERE market_id % 29 = 0"""


def gate_sql(source: str, issues: dict[str, str], notes: dict[str, str] | None = None) -> str:
    rows = [(n, "issue", t) for n, t in issues.items()] + [(n, "note", t) for n, t in (notes or {}).items()]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, '{s}' AS severity, CAST(market_id AS VARCHAR) AS market_id, count(*) AS n FROM {source} WHERE {t} GROUP BY market_id"
        for n, s, t in rows)


META_TESTS = {
    "duplicate_market_id": "copies > 1",
    **{f"empty_{c}": f"{c} IS NULL OR trim(CAST({c} AS VARCHAR)) = ''" for c in Q.REQUIRED_META},
    "placeholder_price": "yes_final_price IN (0.05, 0.95)",
    "outcome_vs_price": "outcome IS NULL OR coalesce(CASE WHEN yes_final_price >= 0.95 THEN 1 WHEN yes_final_price <= 0.05 THEN 0 END, 9) <> outcome",
    "bad_dates": "start_date IS NULL OR end_date IS NULL",
    "end_not_after_start": "end_date <= start_date",
    "duration_mismatch": "floor((epoch_us(end_date) - epoch_us(start_date)) / 86400000000.0) <> duration_days",
    "bad_split": "coalesce(split NOT IN ('train', 'test'), TRUE)",
}


def faulty_meta(spark, d) -> DataFrame:
    V.markets(spark, d).createOrReplaceTempView("tallycast_meta")
    return spark.sql(FAULTY_META.format(m="tallycast_meta"))


@query("q_meta_checks", with_views(gate_sql("t", META_TESTS), "markets", extra={
    "faulty": FAULTY_META.format(m="markets"), "t": "SELECT *, count(*) OVER (PARTITION BY market_id) AS copies FROM faulty"}))
def q_meta_checks(spark, d):
    return Q.check_meta(faulty_meta(spark, d))


@query("q_meta_counts", with_views(f"SELECT check_name, severity, CAST(sum(n) AS BIGINT) AS n, count(*) AS markets, min(market_id) AS first_id FROM ({gate_sql('t', META_TESTS)}) GROUP BY ALL", "markets", extra={
    "faulty": FAULTY_META.format(m="markets"), "t": "SELECT *, count(*) OVER (PARTITION BY market_id) AS copies FROM faulty"}))
def q_meta_counts(spark, d):
    return Q.gate_counts(Q.check_meta(faulty_meta(spark, d)))


EVIDENCE = """SELECT market_id, clob_token_id, question, start_date + INTERVAL '500 milliseconds' * (market_id % 4) AS start_date, end_date, duration_days,
    total_volume + CASE WHEN market_id % 5 = 0 THEN 0.0000001 WHEN market_id % 5 = 1 THEN 0.001 ELSE 0 END AS total_volume, yes_final_price,
    CASE WHEN market_id % 9 = 0 THEN 1 - outcome ELSE outcome END AS outcome FROM {m} WHERE market_id % 8 <> 3"""


def evidence(spark, d) -> DataFrame:
    m = V.markets_unsplit(spark, d).filter("market_id % 8 <> 3")
    mid = F.col("market_id")
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), 0.5 * (mid % 4))
    volume = F.col("total_volume") + F.when(mid % 5 == 0, 1e-7).when(mid % 5 == 1, 1e-3).otherwise(0.0)
    return m.withColumns({"start_date": F.col("start_date") + shift, "total_volume": volume,
                          "outcome": F.when(mid % 9 == 0, 1 - F.col("outcome")).otherwise(F.col("outcome"))})


def differs_sql(c: str) -> str:
    if c in ("start_date", "end_date"):
        return f"abs(epoch_us(m.{c}) - epoch_us(e.{c})) > 1000000"
    if c in ("total_volume", "yes_final_price"):
        return f"abs(m.{c} - e.{c}) > 1e-6::DOUBLE"
    return f"m.{c} IS DISTINCT FROM e.{c}"


TOLERANT_SQL = with_views(
    "SELECT market_id, 'no_evidence' AS problem FROM markets_unsplit WHERE market_id NOT IN (SELECT market_id FROM ev) UNION ALL "
    + " UNION ALL ".join(f"SELECT m.market_id, '{c}_differs' FROM markets_unsplit m JOIN ev e ON e.market_id = m.market_id WHERE {differs_sql(c)}" for c in Q.SOURCE_FIELDS),
    "markets_unsplit", extra={"ev": EVIDENCE.format(m="markets_unsplit")})


@query("c_tolerant_compare", TOLERANT_SQL)
def c_tolerant_compare(spark, d):
    return Q.check_against_source(V.markets_unsplit(spark, d), evidence(spark, d))


@query("q_source_evidence", f"SELECT problem, count(*) AS markets FROM ({TOLERANT_SQL}) GROUP BY problem")
def q_source_evidence(spark, d):
    return Q.check_against_source(V.markets_unsplit(spark, d), evidence(spark, d)).groupBy("problem").agg(F.count(F.lit(1)).alias("markets"))


@query("q_coverage", with_views(
    """SELECT reason, count(*) AS n FROM (
         SELECT CASE WHEN scope_date IS NULL OR scope_date < TIMESTAMP '2023-06-01' THEN 'out_of_scope' WHEN closed_time > (SELECT max(ts) FROM events) THEN 'new_since_fetch' ELSE 'missed' END AS reason
         FROM found WHERE market_id NOT IN (SELECT market_id FROM kept)
         UNION ALL SELECT 'not_returned' FROM kept WHERE market_id NOT IN (SELECT market_id FROM found)) GROUP BY reason""",
    extra={"cat": CATALOGUE_SQL, "found": f"SELECT * FROM cat WHERE {REASON_SQL} IS NULL AND e % 16 <> 0",
           "kept": f"SELECT * FROM cat WHERE {REASON_SQL} IS NULL AND e % 4 < 3"}))
def q_coverage(spark, d):
    number = F.conv(F.substring("market_id", 50, 17), 16, 10).cast("long")
    passed = catalogue(spark, d).filter(C.reject_reason().isNull()).withColumn("e", number)
    out = Q.coverage(passed.filter("e % 16 <> 0"), passed.filter("e % 4 < 3"), newest_event(spark, d).scalar(), "2023-06-01")
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


FAULTY_SNAPSHOTS = """SELECT market_id, CASE WHEN market_id % 10 = 1 THEN snapshot_timestamp - INTERVAL 15 DAY ELSE snapshot_timestamp END AS snapshot_timestamp, days_before_close, pct_lifetime_elapsed,
    price_at_snapshot * CASE WHEN market_id % 10 = 2 THEN 1.5 ELSE 1 END AS price_at_snapshot, price_mean_7d, price_min_7d + CASE WHEN market_id % 10 = 3 THEN 0.5 ELSE 0 END AS price_min_7d, price_max_7d, price_range_7d,
    price_mean_14d, price_min_14d, price_max_14d, price_range_14d, CASE WHEN market_id % 10 = 4 THEN 1 - outcome ELSE outcome END AS outcome,
    split, CASE WHEN market_id % 10 = 5 THEN NULL ELSE category END AS category FROM {s}
    WHERE NOT (market_id % 10 = 6 AND hour(snapshot_timestamp) < 12 AND day(snapshot_timestamp) = 20)"""
BY_ROW = ["market_id", "snapshot_timestamp"]
RAW_TESTS = {
    "duplicate_row": "gap = 0", "bad_gap": "gap <> 43200000000", "not_in_meta": "in_meta IS NULL",
    "before_burn_in": "epoch_us(snapshot_timestamp) < epoch_us(start_date) + 14 * 86400000000 - 1000000",
    "after_end": "epoch_us(snapshot_timestamp) > epoch_us(end_date) + 1000000", "after_closed_time": "epoch_us(snapshot_timestamp) > epoch_us(closed_time) + 1000000",
    "outcome_vs_meta": "outcome IS DISTINCT FROM m_outcome", "split_vs_meta": "split IS DISTINCT FROM m_split",
    "category_vs_meta": "category IS NOT NULL AND category IS DISTINCT FROM m_category", "negative_days_left": "days_before_close < -0.01",
    "elapsed_out_of_range": "pct_lifetime_elapsed < 0 OR pct_lifetime_elapsed > 1",
    **{k: v for w in ("7d", "14d") for k, v in {
        f"mean_outside_{w}": f"price_min_{w} > price_mean_{w} + 1e-4::DOUBLE OR price_mean_{w} > price_max_{w} + 1e-4::DOUBLE",
        f"range_mismatch_{w}": f"abs(price_range_{w} - (price_max_{w} - price_min_{w})) > 2e-4::DOUBLE"}.items()},
}
RAW_NOTES = {"category_blank": "category IS NULL", "price_out_of_range": "price_at_snapshot < 0 OR price_at_snapshot > 1",
             "empty_window_7d": "price_mean_7d IS NULL", "empty_window_14d": "price_mean_14d IS NULL"}


def faulty_snapshots(spark, d) -> DataFrame:
    V.raw_snapshots(spark, d).createOrReplaceTempView("tallycast_raw")
    return spark.sql(FAULTY_SNAPSHOTS.format(s="tallycast_raw"))


@query("q_raw_build_checks", with_views(gate_sql("t", RAW_TESTS, RAW_NOTES), "raw_snapshots", extra={
    "faulty": FAULTY_SNAPSHOTS.format(s="raw_snapshots"),
    "t": """SELECT f.*, m.start_date, m.end_date, m.closed_time, m.outcome AS m_outcome, m.split AS m_split, m.category AS m_category, m.market_id AS in_meta,
              epoch_us(snapshot_timestamp) - lag(epoch_us(snapshot_timestamp)) OVER (PARTITION BY f.market_id ORDER BY snapshot_timestamp) AS gap
            FROM faulty f LEFT JOIN (SELECT * FROM markets WHERE market_id % 40 <> 39) m ON m.market_id = f.market_id"""}))
def q_raw_build_checks(spark, d):
    return Q.check_raw(faulty_snapshots(spark, d), V.markets(spark, d).filter("market_id % 40 <> 39"))


COMPARED = ["pct_lifetime_elapsed", "price_at_snapshot", *rolling_columns()]
SAME_COLUMNS = ", ".join(c for c in rolling_columns() if c != "price_mean_7d")
NEW_BUILD = """SELECT market_id, snapshot_timestamp, days_before_close + CASE WHEN market_id % 5 = 1 THEN 2 WHEN market_id % 5 = 2 THEN day(snapshot_timestamp) ELSE 0 END AS days_before_close, pct_lifetime_elapsed,
    price_at_snapshot + CASE WHEN market_id % 7 = 3 AND hour(snapshot_timestamp) < 6 THEN 0.01 ELSE 0 END AS price_at_snapshot,
    CASE WHEN market_id % 11 = 5 THEN NULL ELSE price_mean_7d END AS price_mean_7d, """ + SAME_COLUMNS + """ FROM {s} WHERE NOT (market_id % 3 = 0 AND day(snapshot_timestamp) = 18)"""
OLD_BUILD = "SELECT market_id, snapshot_timestamp, days_before_close, pct_lifetime_elapsed, price_at_snapshot, price_mean_7d, " + SAME_COLUMNS + " FROM {s} WHERE NOT (market_id % 4 = 0 AND day(snapshot_timestamp) = 20) AND market_id % 20 <> 19"


def compare_sql() -> str:
    dated = "coalesce(abs(spread) <= 0.02, FALSE)"
    both, old_only, new_only = "o_id IS NOT NULL AND n_id IS NOT NULL", "n_id IS NULL", "o_id IS NULL"
    closed, last = "coalesce(ts > closed_time, FALSE)", "coalesce(n_dbc <= 14.5, FALSE)"
    issues = {"shift_not_constant": f"{both} AND abs(spread) > 0.02 AND abs(n_dbc - o_dbc) > 1e-6::DOUBLE",
              "old_only_unexplained": f"{old_only} AND NOT {closed} AND NOT {dated}", "new_only_unexplained": f"{new_only} AND NOT {last} AND NOT {dated}"}
    notes = {"in_both": both, "old_only_after_close": f"{old_only} AND {closed}", "new_only_last_days": f"{new_only} AND {last}",
             "old_only_end_changed": f"{old_only} AND NOT {closed} AND {dated}", "new_only_end_changed": f"{new_only} AND NOT {last} AND {dated}"}
    for c in COMPARED:
        tol = "1.01e-4::DOUBLE" if c == "pct_lifetime_elapsed" else "1e-6::DOUBLE"
        extra = f" AND NOT {dated}" if c == "pct_lifetime_elapsed" else ""
        issues[f"{c}_differs"] = f"{both} AND ((o_{c} IS NULL) <> (n_{c} IS NULL) OR coalesce(abs(o_{c} - n_{c}) > {tol} + 1e-5::DOUBLE * abs(n_{c}), FALSE)){extra}"
    return gate_sql("t", issues, notes)


@query("q_compare_builds", with_views(compare_sql(), "snapshots", extra={
    "o": OLD_BUILD.format(s="snapshots"), "n": f"SELECT * FROM ({NEW_BUILD.format(s='snapshots')}) WHERE market_id IN (SELECT market_id FROM o)",
    "j": """SELECT coalesce(o.market_id, n.market_id) AS market_id, coalesce(o.snapshot_timestamp, n.snapshot_timestamp) AS ts, o.market_id AS o_id, n.market_id AS n_id,
              o.days_before_close AS o_dbc, n.days_before_close AS n_dbc, """ + ", ".join(f"o.{c} AS o_{c}, n.{c} AS n_{c}" for c in COMPARED) +
         " FROM o FULL JOIN n ON o.market_id = n.market_id AND o.snapshot_timestamp = n.snapshot_timestamp",
    "t": """SELECT j.*, s.spread, m.closed_time FROM j LEFT JOIN (SELECT market_id, max(n_dbc - o_dbc) - min(n_dbc - o_dbc) AS spread FROM j WHERE abs(n_dbc - o_dbc) > 1e-6::DOUBLE GROUP BY 1) s
            ON s.market_id = j.market_id LEFT JOIN markets m ON m.market_id = j.market_id"""}))
def q_compare_builds(spark, d):
    cut(V.snapshots(spark, d)).createOrReplaceTempView("tallycast_build")
    old, new = spark.sql(OLD_BUILD.format(s="tallycast_build")), spark.sql(NEW_BUILD.format(s="tallycast_build"))
    return Q.compare_builds(old, new, V.markets_unsplit(spark, d), COMPARED)


@query("c_full_outer", with_views(
    """SELECT CASE WHEN n.market_id IS NULL THEN 'left_only' WHEN o.market_id IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n
       FROM o FULL JOIN n ON o.market_id = n.market_id AND o.snapshot_timestamp = n.snapshot_timestamp GROUP BY 1""", "snapshots",
    extra={"o": OLD_BUILD.format(s="snapshots"), "n": NEW_BUILD.format(s="snapshots")}))
def c_full_outer(spark, d):
    V.snapshots(spark, d).createOrReplaceTempView("tallycast_build")
    o = spark.sql(OLD_BUILD.format(s="tallycast_build")).select(*BY_ROW).withColumn("o", F.lit(1))
    n = spark.sql(NEW_BUILD.format(s="tallycast_build")).select(*BY_ROW).withColumn("n", F.lit(1))
    side = F.when(F.col("n").isNull(), "left_only").when(F.col("o").isNull(), "right_only").otherwise("both")
    return o.join(n, BY_ROW, "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("c_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 10)")
def c_anti_join(spark, d):
    big = V.table(spark, d, "lineitem").filter("l_quantity >= 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_anti")


@query("c_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def c_semi_join(spark, d):
    big = V.table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


DIGESTED = ["price_at_snapshot", "days_before_close", "pct_lifetime_elapsed", "duration_days", *rolling_columns(), "outcome", "category"]
MILLIONTHS = [c for c in DIGESTED if c not in ("outcome", "category", "duration_days")]


def digest_sql(columns: list[str]) -> str:
    """Text of a row's digest; numbers enter as whole millionths, which every engine writes alike."""
    text = " || '|' || ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in columns)
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def whole_columns(spark, d) -> DataFrame:
    """Every feature of the snapshot table, numbers in whole millionths, times in microseconds."""
    s = V.snapshots(spark, d).select("market_id", micros("snapshot_timestamp").alias("us"), *DIGESTED)
    return s.withColumns({c: F.floor(F.col(c) * 1e6 + 0.500001).cast("bigint") for c in MILLIONTHS})


@query("d_market_digest", with_views(
    f"""SELECT market_id, count(*) AS n, CAST(sum(h & 1073741823) AS BIGINT) AS lo, CAST(sum(h >> 30) AS BIGINT) AS hi FROM (
          SELECT market_id, {digest_sql(sorted(['market_id', 'us', *DIGESTED]))} AS h FROM (
            SELECT market_id, epoch_us(snapshot_timestamp) AS us, duration_days, outcome, category, {', '.join(f'CAST(floor({c} * 1e6::DOUBLE + 0.500001::DOUBLE) AS BIGINT) AS {c}' for c in MILLIONTHS)} FROM snapshots)) GROUP BY market_id""", "snapshots"))
def d_market_digest(spark, d):
    return Q.market_digests(whole_columns(spark, d)).select("market_id", "digest.*")


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


@query("d_table_digest", f"""SELECT count(*) AS n, CAST(CAST(sum(h) AS HUGEINT) % 18446744073709551616::HUGEINT AS VARCHAR) AS digest FROM (
    SELECT CAST({digest_sql([*LINE_KEYS[:4], 'CAST(l_shipdate AS DATE)'])} AS HUGEINT) AS h FROM lineitem)""")
def d_table_digest(spark, d):
    return Q.table_digest(V.table(spark, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date")), LINE_KEYS)


@query("q_parent_compare", """SELECT state, count(*) AS markets FROM (SELECT user_id AS market_id, CASE WHEN user_id % 10 = 0 THEN 'gone' WHEN user_id % 10 = 1 AND user_id % 4 = 1 THEN 'added_not_built'
      WHEN user_id % 10 = 1 THEN 'added' WHEN user_id % 10 = 2 THEN 'changed' WHEN user_id % 10 = 3 THEN 'recategorised' ELSE 'same' END AS state FROM events GROUP BY user_id) GROUP BY state""")
def q_parent_compare(spark, d):
    base = V.prices(spark, d).select("market_id", "ts", "price").withColumn("category", F.lit("a")).withColumn("split", F.lit("train"))
    mid = F.col("market_id")
    parent = base.filter(mid % 10 != 1)
    new = base.filter(mid % 10 != 0).withColumns({
        "price": F.when((mid % 10 == 2), F.col("price") + 1).otherwise(F.col("price")),
        "category": F.when(mid % 10 == 3, "b").otherwise(F.col("category")), "split": F.lit("test")})
    built = base.filter(mid % 4 != 1).select("market_id")
    return Q.compare_with_parent(new, parent, built).groupBy("state").agg(F.count(F.lit(1)).alias("markets"))


FEATURES = ["price_at_snapshot", "days_before_close", *rolling_columns()]
CLEAN_TESTS = {
    "settled_price": "price_at_snapshot >= 0.95 OR price_at_snapshot <= 0.05", "null_feature": " OR ".join(f"{c} IS NULL" for c in FEATURES),
    "outcome_vs_meta": "outcome IS DISTINCT FROM m_outcome", "category_vs_meta": "category IS DISTINCT FROM m_category",
    "train_after_cutoff": "split = 'train' AND snapshot_timestamp >= cutoff", "test_before_cutoff": "split = 'test' AND snapshot_timestamp < cutoff",
    "pre_cutoff_after_cutoff": "split = 'test_pre_cutoff' AND snapshot_timestamp >= cutoff"}


@query("q_clean_checks", with_views(gate_sql("t", CLEAN_TESTS), "raw_snapshots", extra={
    "t": """SELECT s.*, m.outcome AS m_outcome, m.category AS m_category, (SELECT max(closed_time) FROM markets WHERE split = 'train') AS cutoff
            FROM raw_snapshots s LEFT JOIN markets m ON m.market_id = s.market_id"""}))
def q_clean_checks(spark, d):
    return Q.check_clean(V.raw_snapshots(spark, d), V.markets(spark, d), FEATURES)


@query("q_feature_parity", with_views(
    "SELECT feature, count(*) AS n, count(*) FILTER (diff IS NULL) AS absent, count(*) FILTER (diff > 1e-6::DOUBLE) AS off, " + r("max(diff)", 6) + " AS max_diff FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN {c} IS NULL OR market_id % 9 = 0 THEN NULL WHEN market_id % 5 = 0 THEN 0.01::DOUBLE ELSE 0 END AS diff FROM raw_snapshots" for c in COMPARED)
    + ") GROUP BY feature", "raw_snapshots"))
def q_feature_parity(spark, d):
    stored = cut(V.raw_snapshots(spark, d).select(*BY_ROW, *COMPARED))
    again = stored.filter("market_id % 9 <> 0").withColumns(
        {c: F.col(c) + F.when(F.col("market_id") % 5 == 0, 0.01).otherwise(0.0) for c in COMPARED})
    return rnd(Q.parity(stored, again, BY_ROW, COMPARED, 1e-6), "max_diff")


RECOMPUTED = [f"price_{s}_{d}d" for d in (7, 14) for s in Q.RECOMPUTED]


def recomputed_sql(d: int) -> str:
    inside = f"FILTER (epoch_us(p.ts) >= epoch_us(s.snapshot_timestamp) - {d} * 86400000000)"
    of = {"mean": f"avg(p.price) {inside}", "min": f"min(p.price) {inside}", "max": f"max(p.price) {inside}", "range": f"max(p.price) {inside} - min(p.price) {inside}",
          "change": f"arg_max(p.price, (p.ts, p.event_id)) {inside} - arg_min(p.price, (p.ts, p.event_id)) {inside}"}
    return ", ".join(f"CASE WHEN count(*) {inside} >= 2 THEN {r(e, 4)} END AS price_{s}_{d}d" for s, e in of.items())


@query("q_recomputed_features", with_views(
    "SELECT feature, count(*) AS n, count(*) FILTER (diff IS NULL) AS absent, count(*) FILTER (diff > 1e-6::DOUBLE) AS off, " + r("max(diff)", 6) + " AS max_diff FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(s.{c} - a.{c}) AS diff FROM raw_snapshots s LEFT JOIN a USING (market_id, snapshot_timestamp)" for c in RECOMPUTED)
    + ") GROUP BY feature", "raw_snapshots", "prices", extra={
        "p": """SELECT market_id, event_id, ts, CASE WHEN market_id % 5 = 0 AND event_id % 3 = 0 THEN price / 2 ELSE price END AS price
                FROM prices WHERE NOT (market_id % 9 = 0 AND event_id % 2 = 0)""",
        "a": f"""SELECT s.market_id, s.snapshot_timestamp, {recomputed_sql(7)}, {recomputed_sql(14)} FROM raw_snapshots s
                JOIN p ON p.market_id = s.market_id AND p.ts <= s.snapshot_timestamp AND epoch_us(p.ts) >= epoch_us(s.snapshot_timestamp) - 14 * 86400000000
                GROUP BY ALL"""}))
def q_recomputed_features(spark, d):
    """The stored table against features made anew from prices in which some are halved and some are missing."""
    stored = cut(V.raw_snapshots(spark, d).select(*BY_ROW, *RECOMPUTED))
    halved = (F.col("market_id") % 5 == 0) & (F.col("event_id") % 3 == 0)
    faulty = V.prices(spark, d).filter("NOT (market_id % 9 = 0 AND event_id % 2 = 0)").withColumn("price", F.when(halved, F.col("price") / 2).otherwise(F.col("price")))
    return rnd(Q.parity(stored, Q.recompute_windows(stored, faulty), BY_ROW, RECOMPUTED, 1e-6), "max_diff")


@query("c_reproduce_scores", with_views(
    f"""SELECT 'p' AS feature, count(*) AS n, count(*) FILTER (market_id % 100 = 7) AS absent, count(*) FILTER (market_id % 100 = 8) AS off,
         {r("max(CASE WHEN market_id % 100 = 8 THEN 0.001::DOUBLE ELSE 0 END)", 6)} AS max_diff FROM scored""", "scored"))
def c_reproduce_scores(spark, d):
    stored = V.scored(spark, d).select("row_key", "market_id", F.col("p_model_a").alias("p"))
    again = stored.filter("market_id % 100 <> 7").select("row_key", (F.col("p") + F.when(F.col("market_id") % 100 == 8, 0.001).otherwise(0.0)).alias("p"))
    return rnd(Q.parity(stored, again, ["row_key"], ["p"], 1e-6), "max_diff")


REFRESH = ["question", "end_date", "total_volume", "outcome"]


@query("q_refresh_report", with_views(gate_sql("t", {}, {
    "changed_question": "n_id IS NOT NULL AND market_id % 6 = 1", "changed_end_date": "n_id IS NOT NULL AND market_id % 6 = 2",
    "changed_total_volume": "n_id IS NOT NULL AND market_id % 6 = 3", "changed_outcome": "n_id IS NOT NULL AND market_id % 6 = 4",
    "flipped_outcome": "n_id IS NOT NULL AND market_id % 6 = 4", "dropped": "n_id IS NULL"}), "markets_unsplit",
    extra={"t": "SELECT market_id, CASE WHEN market_id % 7 <> 0 THEN 1 END AS n_id FROM markets_unsplit"}))
def q_refresh_report(spark, d):
    m = V.markets_unsplit(spark, d)
    mid = F.col("market_id")
    after = m.filter("market_id % 7 <> 0").withColumns({
        "question": F.when(mid % 6 == 1, F.concat("question", F.lit("!"))).otherwise(F.col("question")),
        "end_date": F.when(mid % 6 == 2, F.col("end_date") + days(1)).otherwise(F.col("end_date")),
        "total_volume": F.when(mid % 6 == 3, F.col("total_volume") + 1).otherwise(F.col("total_volume")),
        "outcome": F.when(mid % 6 == 4, 1 - F.col("outcome")).otherwise(F.col("outcome"))})
    return Q.refresh_report(m, after, REFRESH)


@query("q_split_moves", with_views(
    """SELECT count(*) AS markets, count(*) FILTER (o.split <> m.split) AS moved, (SELECT max(closed_time) FROM o WHERE split = 'train') AS cutoff_before,
         (SELECT max(closed_time) FROM markets WHERE split = 'train') AS cutoff_after,
         (SELECT max(closed_time) FROM markets WHERE split = 'train') < (SELECT max(closed_time) FROM o WHERE split = 'train') AS moved_back
       FROM o JOIN markets m ON m.market_id = o.market_id""", "markets",
    extra={"o": "SELECT * REPLACE (CASE WHEN market_id % 2 = 0 THEN 'train' ELSE 'test' END AS split) FROM markets"}))
def q_split_moves(spark, d):
    new = V.markets(spark, d)
    old = V.markets_unsplit(spark, d).withColumn("split", F.when(F.col("market_id") % 2 == 0, "train").otherwise("test"))
    return Q.split_moves(old, new)


@query("q_row_invariant", with_views("SELECT (SELECT count(*) FROM snapshots) AS rows_in, (SELECT count(*) FROM with_trends) AS rows_out", "with_trends"))
def q_row_invariant(spark, d):
    from tallycast.operators.trends import merge_trends

    snaps = V.snapshots(spark, d)
    return snaps.agg(F.count(F.lit(1)).alias("rows_in")).withColumn(
        "rows_out", merge_trends(snaps, V.trends(spark, d)).agg(F.count(F.lit(1)).alias("n")).scalar())


@query("q_unpublished", "SELECT DISTINCT user_id AS market_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)")
def q_unpublished(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("market_id"), "event_type", "value")
    parent = e.filter("event_type = 'purchase' AND value > 150")
    return e.select("market_id").distinct().join(parent.select("market_id"), "market_id", "left_anti")


@query("q_build_settings", "SELECT event_type AS name, CAST(count(*) AS VARCHAR) AS stored, CAST(count(*) FILTER (value > 0.05) AS VARCHAR) AS wanted FROM events GROUP BY 1 HAVING count(*) <> count(*) FILTER (value > 0.05)")
def q_build_settings(spark, d):
    e = V.table(spark, d, "events")
    value = F.count(F.lit(1)).cast("string").alias("value")
    stored = e.groupBy(F.col("event_type").alias("name")).agg(value)
    wanted = e.filter("value > 0.05").groupBy(F.col("event_type").alias("name")).agg(value)
    return Q.settings_differ(stored, wanted)


@query("q_mixed_versions", "SELECT o_orderpriority AS file, count(DISTINCT o_orderstatus) AS versions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def q_mixed_versions(spark, d):
    o = V.table(spark, d, "orders").select("o_orderpriority", F.col("o_orderstatus").alias("dataset_version"))
    return Q.mixed_versions(o, F.col("o_orderpriority"))


EXPLORE_TESTS = {"price_above_one": "price_at_snapshot > 1", "price_below_zero": "price_at_snapshot < 0", "negative_days": "days_before_close < 0",
                 "null_category": "category IS NULL", "null_7d": "price_mean_7d IS NULL", "near_certain": "price_at_snapshot >= 0.95 OR price_at_snapshot <= 0.05"}


@query("q_exploration", with_views(gate_sql("raw_snapshots", {}, EXPLORE_TESTS), "raw_snapshots"))
def q_exploration(spark, d):
    return Q.gate_table(V.raw_snapshots(spark, d), {}, {n: F.expr(t) for n, t in EXPLORE_TESTS.items()})


# ---------------------------------------------------------------- release comparison

@query("q_behaviour", with_views(
    f"""SELECT {r('avg(abs(p_model_b - p_model_a))', 6)} AS mean_move, {r('avg(CASE WHEN abs(p_model_b - p_model_a) > 0.05 THEN 1 ELSE 0 END)', 6)} AS share_moved,
          {r('avg(CASE WHEN (p_model_a >= 0.5) <> (p_model_b >= 0.45) THEN 1 ELSE 0 END)', 6)} AS flip_rate, {r('quantile_cont(abs(p_model_b - p_model_a), 0.95)', 6)} AS p95_move FROM scored""", "scored"))
def q_behaviour(spark, d):
    return rnd(RL.behaviour(V.scored(spark, d), "p_model_a", "p_model_b", 0.5, 0.45), "mean_move", "share_moved", "flip_rate", "p95_move")


def importances(spark, d, outcome: str) -> DataFrame:
    cols = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    line = V.table(spark, d, "lineitem").withColumn("y", F.expr(f"CAST({outcome} AS INT)"))
    one = line.agg(*[half_up(F.abs(F.corr(c, "y")), 6).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in cols])))


def importance_sql(outcome: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'abs(corr({c}, CASE WHEN {outcome} THEN 1 ELSE 0 END))', 6)} AS importance FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))


@query("q_importance_shifts", with_views(
    f"""SELECT a.feature, a.importance AS old, b.importance AS new, {r('abs(b.importance - a.importance)', 6)} AS shift FROM a JOIN b ON a.feature = b.feature
        WHERE {r('abs(b.importance - a.importance)', 6)} >= 0.0005 ORDER BY shift DESC, a.feature DESC LIMIT 5""",
    extra={"a": importance_sql("l_returnflag = 'R'"), "b": importance_sql("l_linestatus = 'O'")}))
def q_importance_shifts(spark, d):
    return RL.importance_shifts(importances(spark, d, "l_returnflag = 'R'"), importances(spark, d, "l_linestatus = 'O'"))


@query("g_feature_sets", """SELECT model, list_sort(list_filter(new, lambda x: NOT list_contains(old, x))) AS added, list_sort(list_filter(old, lambda x: NOT list_contains(new, x))) AS removed FROM (
    SELECT r_name AS model, list(DISTINCT n_name) FILTER (n_nationkey % 3 <> 0) AS new, list(DISTINCT n_name) FILTER (n_nationkey % 4 <> 0) AS old
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)""")
def g_feature_sets(spark, d):
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sets = lambda cond: n.filter(cond).groupBy(F.col("r_name").alias("model")).agg(F.collect_set("n_name").alias("features"))
    return RL.settings_and_features(sets("n_nationkey % 4 <> 0"), sets("n_nationkey % 3 <> 0"))


@query("q_attribution", with_views(
    f"""SELECT step, {r('m.auc', 6)} AS auc, {r('b.auc', 6)} AS market_auc, {r('m.log_loss', 6)} AS log_loss, {r('m.auc - b.auc', 6)} AS edge
        FROM {metric_sql('steps', ['step'])} m JOIN {metric_sql('steps', ['step'], p='price_at_snapshot')} b USING (step)""", "scored",
    extra={"steps": """SELECT *, '1 old on old' AS step, p_model_a AS p FROM scored WHERE snapshot_timestamp < TIMESTAMP '1998-06-01' UNION ALL
        SELECT *, '2 old on new', p_model_a FROM scored WHERE snapshot_timestamp >= TIMESTAMP '1998-06-01' UNION ALL
        SELECT *, '3 new on new', p_model_b FROM scored WHERE snapshot_timestamp >= TIMESTAMP '1998-06-01'"""}))
def q_attribution(spark, d):
    early = F.col("snapshot_timestamp") < F.lit("1998-06-01").cast("timestamp_ntz")
    step = lambda n, p: F.struct(F.lit(n).alias("step"), F.col(p).alias("p"))
    steps = F.when(early, F.array(step("1 old on old", "p_model_a"))).otherwise(F.array(step("2 old on new", "p_model_a"), step("3 new on new", "p_model_b")))
    df = V.scored(spark, d).select("outcome", "price_at_snapshot", F.inline(steps))
    model = M.metric_table(df, ["step"]).select("step", "auc", "log_loss")
    market = M.auc(df, ["step"], "price_at_snapshot").withColumnRenamed("auc", "market_auc")
    return rnd(RL.attribution(model.join(market, "step")), "auc", "market_auc", "log_loss", "edge")


@query("q_promotion_checks")
def q_promotion_checks(spark, d):
    df = cut(V.scored(spark, d).select("market_id", "outcome", "price_at_snapshot", "p_model_a", "p_model_b"))
    a = BS.bootstrap_auc_diff(df, "p_model_a", "p_model_b", "market_id", AUC_BOOTS)
    edge = BS.bootstrap_auc_diff(df, "price_at_snapshot", "p_model_b", "market_id", AUC_BOOTS)
    loss = BS.bootstrap_loss_diff(df, "p_model_a", "p_model_b", "market_id", LOSS_BOOTS).filter("measure = 'log_loss'")
    ece = lambda c: M.expected_calibration_error(df, [], p=c).scalar()
    row = loss.select(F.lit("model").alias("model"), F.col("ci_lo").alias("loss_lo"), F.col("ci_hi").alias("loss_hi"))
    row = row.withColumns({"auc_lo": a.select("ci_lo").scalar(), "auc_hi": a.select("ci_hi").scalar(), "edge_lo": edge.select("ci_lo").scalar(),
                           "ece_old": ece("p_model_a"), "ece_new": ece("p_model_b")})
    return RL.promotion_checks(row)


# ---------------------------------------------------------------- live lookups

NOW_SQL = "((SELECT max(ts) FROM events))"
LOOKUPS_SQL = f"""SELECT event_id AS lookup_id, CASE WHEN event_id % 2 = 0 THEN 'sample' ELSE 'search' END AS source, event_id % 4000 AS market_id, ts,
    CASE WHEN event_id % 9 <> 0 THEN 'r' || (1 + user_id % 2) END AS release, {r('least(value, 100.0) / 100.0', 4)} AS market_price,
    {r('least(value, 150.0) / 150.0', 4)} AS model_a, CASE WHEN event_id % 50 <> 0 THEN {r('least(value, 300.0) / 300.0', 4)} END AS model_b FROM events"""
LIVE_MARKETS_SQL = """SELECT k AS market_id, CASE WHEN k % 5 = 0 THEN 'open' WHEN k % 11 = 0 THEN 'ambiguous' ELSE 'resolved' END AS resolution_status,
    CASE WHEN k % 5 <> 0 AND k % 11 <> 0 THEN CAST(k % 3 = 0 AS INTEGER) END AS outcome, CASE WHEN k % 17 <> 0 THEN 30 + k % 670 END AS duration_days
    FROM (SELECT DISTINCT event_id % 4000 AS k FROM events)"""


def lookups(spark, d) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    share = lambda top: half_up(F.least(v, F.lit(top)) / top, 4)
    return V.table(spark, d, "events").select(
        e.alias("lookup_id"), F.when(e % 2 == 0, "sample").otherwise("search").alias("source"), (e % 4000).alias("market_id"), "ts",
        F.when(e % 9 != 0, F.concat(F.lit("r"), (1 + F.col("user_id") % 2).cast("string"))).alias("release"),
        share(100.0).alias("market_price"), share(150.0).alias("model_a"), F.when(e % 50 != 0, share(300.0)).alias("model_b"))


def live_markets(spark, d) -> DataFrame:
    k = F.col("market_id")
    done = (k % 5 != 0) & (k % 11 != 0)
    ids = V.table(spark, d, "events").select((F.col("event_id") % 4000).alias("market_id")).distinct()
    return ids.select("market_id", F.when(k % 5 == 0, "open").when(k % 11 == 0, "ambiguous").otherwise("resolved").alias("resolution_status"),
                      F.when(done, (k % 3 == 0).cast("int")).alias("outcome"), F.when(k % 17 != 0, 30 + k % 670).alias("duration_days"))


def first_with_markets(spark, d) -> DataFrame:
    return L.first_lookups(lookups(spark, d)).join(live_markets(spark, d), "market_id")


FIRST = {"lk": LOOKUPS_SQL, "mk": LIVE_MARKETS_SQL,
         "first": """SELECT f.*, m.resolution_status, m.outcome, m.duration_days FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, market_id ORDER BY ts, lookup_id) AS rn
             FROM lk WHERE release IS NOT NULL) WHERE rn = 1) f JOIN mk m ON m.market_id = f.market_id"""}
DONE_SQL = "SELECT * FROM first WHERE resolution_status = 'resolved' AND outcome IS NOT NULL AND market_price IS NOT NULL AND model_a IS NOT NULL AND model_b IS NOT NULL"
FIRST["done"] = DONE_SQL


@query("e_first_lookups", with_views("SELECT source, market_id, lookup_id, release FROM first", extra=FIRST))
def e_first_lookups(spark, d):
    return L.first_lookups(lookups(spark, d)).select("source", "market_id", "lookup_id", "release")


@query("c_live_join", with_views(
    """SELECT source, market_id, release, market_price, resolution_status, outcome, duration_days, model, probability FROM (
         SELECT *, 'model_a' AS model, model_a AS probability FROM first UNION ALL SELECT *, 'model_b', model_b FROM first) WHERE probability IS NOT NULL""", extra=FIRST))
def c_live_join(spark, d):
    firsts = L.first_lookups(lookups(spark, d).drop("model_a", "model_b")).drop("ts")
    wide = lookups(spark, d)
    runs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("probability")) for m in ("model_a", "model_b")])
    preds = wide.select("lookup_id", F.inline(runs)).filter("probability IS NOT NULL")
    return firsts.join(live_markets(spark, d), "market_id").join(preds, "lookup_id").drop("lookup_id")


@query("d_pivot_lookups", with_views("SELECT source, market_id, release, model_a, model_b FROM first", extra=FIRST))
def d_pivot_lookups(spark, d):
    firsts = L.first_lookups(lookups(spark, d))
    long = firsts.select("source", "market_id", "release", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("model_a", "model_b")])))
    return long.groupBy("source", "market_id", "release").pivot("model", ["model_a", "model_b"]).agg(F.max("p"))


@query("q_track_status", with_views(
    """SELECT release, source, count(*) AS markets, count(*) FILTER (resolution_status = 'open') AS open, count(*) FILTER (resolution_status = 'resolved') AS resolved,
         count(*) FILTER (resolution_status = 'ambiguous') AS ambiguous FROM first GROUP BY ALL""", extra=FIRST))
def q_track_status(spark, d):
    return L.status_counts(first_with_markets(spark, d), ["release", "source"])


LIVE_LONG = """SELECT *, 'market' AS model, market_price AS p FROM {t} UNION ALL SELECT *, 'model_a', model_a FROM {t} UNION ALL SELECT *, 'model_b', model_b FROM {t}"""
ENOUGH = "SELECT * FROM done SEMI JOIN (SELECT {k} FROM done GROUP BY ALL HAVING count(*) >= 100 AND count(DISTINCT outcome) = 2) USING ({k})"


@query("q_track_record", with_views(
    f"SELECT release, source, model, n, {rounded(METRICS)} FROM {metric_sql('long', ['release', 'source', 'model'])}",
    extra={**FIRST, "enough": ENOUGH.format(k="release, source"), "long": LIVE_LONG.format(t="enough")}))
def q_track_record(spark, d):
    done = L.scorable(first_with_markets(spark, d), ["model_a", "model_b"])
    return rnd(L.record_metrics(done, ["release", "source"], ["model_a", "model_b"]), *METRICS)


@query("q_track_weighted", with_views(
    f"SELECT release, source, model, n, {rounded(METRICS)} FROM {metric_sql('long', ['release', 'source', 'model'], w='w')}",
    extra={**FIRST, "done": DONE_SQL.replace("SELECT *", "SELECT *, 1.0::DOUBLE / greatest(duration_days - 14, 1) AS w") + " AND duration_days IS NOT NULL AND source = 'sample'",
           "enough": ENOUGH.format(k="release, source"), "long": LIVE_LONG.format(t="enough")}))
def q_track_weighted(spark, d):
    done = L.scorable(first_with_markets(spark, d), ["model_a", "model_b"]).filter("duration_days IS NOT NULL AND source = 'sample'")
    return rnd(L.record_metrics(done.withColumn("w", L.length_weight()), ["release", "source"], ["model_a", "model_b"], "w"), *METRICS)


@query("q_track_by_duration", with_views(
    f"SELECT release, bucket, model, n, {rounded(METRICS)} FROM {metric_sql('long', ['release', 'bucket', 'model'])}",
    extra={**FIRST, "done": DONE_SQL.replace("SELECT *", "SELECT *, CASE WHEN duration_days > 0 AND duration_days <= 90 THEN '<=90d' WHEN duration_days > 90 AND duration_days <= 365 THEN '90-365d' WHEN duration_days > 365 THEN '>365d' END AS bucket") + " AND duration_days IS NOT NULL",
           "enough": ENOUGH.format(k="release, bucket"), "long": LIVE_LONG.format(t="enough")}))
def q_track_by_duration(spark, d):
    done = L.scorable(first_with_markets(spark, d), ["model_a", "model_b"]).filter("duration_days IS NOT NULL").withColumn("bucket", L.live_bucket())
    return rnd(L.record_metrics(done, ["release", "bucket"], ["model_a", "model_b"]), *METRICS)


@query("q_track_intervals", auc_boot_sql("market_id", AUC_BOOTS, "one", "1", "market_price", "model_a", views=(), extra={
    **FIRST, "one": "SELECT * FROM done WHERE release = 'r1' AND source = 'sample'"}))
def q_track_intervals(spark, d):
    """Model against market on the first lookups of one release and source."""
    done = L.scorable(first_with_markets(spark, d), ["model_a", "model_b"]).filter("release = 'r1' AND source = 'sample'")
    return rnd(L.vs_market_intervals(done, "model_a", AUC_BOOTS), "ci_lo", "ci_hi", "point")


@query("q_resolve_open", with_views(
    """SELECT m.market_id, CASE WHEN hit AND (price >= 0.95 OR price <= 0.05) THEN 'resolved' WHEN hit THEN 'ambiguous' ELSE resolution_status END AS resolution_status,
         CASE WHEN hit THEN CASE WHEN price >= 0.95 THEN 1 WHEN price <= 0.05 THEN 0 END ELSE outcome END AS outcome, CASE WHEN hit THEN ct END AS closed_time
       FROM (SELECT m.*, c.yes_price AS price, c.closed_time AS ct, m.resolution_status = 'open' AND c.e IS NOT NULL AS hit FROM mk m LEFT JOIN (SELECT * FROM cat WHERE closed) c ON c.e = m.market_id) m""",
    extra={"cat": CATALOGUE_SQL, "mk": LIVE_MARKETS_SQL}))
def q_resolve_open(spark, d):
    number = F.conv(F.substring("market_id", 50, 17), 16, 10).cast("long")
    listed = catalogue(spark, d).withColumn("market_id", number)
    known = live_markets(spark, d).drop("duration_days").withColumn("closed_time", F.lit(None).cast("timestamp_ntz"))
    return L.resolve_open(known, listed)


LIVE_CAT = f"""SELECT *, CASE WHEN end_date IS NULL OR end_date <= created_at THEN TRUE ELSE FALSE END AS no_end, e % 40 AS n_prices FROM cat WHERE created_at IS NOT NULL"""
WARNINGS_SQL = f"""list_filter([CASE WHEN n_prices < 20 THEN 'few_prices' END,
    CASE WHEN no_end THEN 'no_end_date' WHEN end_date <= {NOW_SQL} THEN 'past_end_date' WHEN {r(f'(epoch_us(end_date) - epoch_us{NOW_SQL}) / 86400000000.0', 2)} < 30 THEN 'near_close' END,
    CASE WHEN {NOW_SQL} < created_at + INTERVAL 14 DAY THEN 'young_market' END, CASE WHEN yes_price >= 0.95 OR yes_price <= 0.05 THEN 'settled_price' END,
    CASE WHEN NOT no_end AND floor((epoch_us(end_date) - epoch_us(created_at)) / 86400000000.0) > 365 THEN 'long_market' END,
    CASE WHEN coalesce(NOT no_end AND floor((epoch_us(end_date) - epoch_us(created_at)) / 86400000000.0) < 30, FALSE) OR volume < 1000 THEN 'outside_filters' END,
    CASE WHEN category IS NULL THEN 'no_category' END], lambda x: x IS NOT NULL)"""


def live_catalogue(spark, d) -> DataFrame:
    number = F.conv(F.substring("market_id", 50, 17), 16, 10).cast("long")
    df = catalogue(spark, d).filter("created_at IS NOT NULL").withColumn("e", number)
    return df.withColumns({"n_prices": F.col("e") % 40, "start_date": F.col("created_at"), "price_at_snapshot": F.col("yes_price"),
                           "total_volume": F.col("volume"), "category": C.clean_text("category")})


LIVE_EXTRA = {"cat": CATALOGUE_SQL, "lc": LIVE_CAT.replace("SELECT *", "SELECT * REPLACE (nullif(trim(category), '') AS category)"),
              "warned": f"SELECT *, {WARNINGS_SQL} AS warnings FROM lc"}


@query("b_warning_codes", with_views("SELECT market_id, array_to_string(warnings, ',') AS warnings FROM warned", extra=LIVE_EXTRA))
def b_warning_codes(spark, d):
    now = newest_event(spark, d).scalar()
    return live_catalogue(spark, d).select("market_id", F.array_join(L.warning_codes(now), ",").alias("warnings"))


REJECT_LIST = ", ".join(f"'{c}'" for c in L.REJECTING)


@query("b_rejected", with_views(f"SELECT list_has_any(warnings, [{REJECT_LIST}]) AS rejected, count(*) AS n FROM warned GROUP BY 1", extra=LIVE_EXTRA))
def b_rejected(spark, d):
    now = newest_event(spark, d).scalar()
    rows = live_catalogue(spark, d).withColumn("warnings", L.warning_codes(now))
    return rows.groupBy(L.is_rejected().alias("rejected")).agg(F.count(F.lit(1)).alias("n"))


ELIGIBLE_SQL = f"""coalesce(n_outcomes = 2 AND NOT closed AND market_id IS NOT NULL AND n_tokens > 0 AND scope_date >= TIMESTAMP '2023-01-01' AND coalesce(volume, 0) >= 1000
    AND end_date > {NOW_SQL} AND floor((epoch_us(end_date) - epoch_us(created_at)) / 86400000000.0) >= 30 AND created_at <= {NOW_SQL} - INTERVAL 14 DAY AND yes_price > 0.05 AND yes_price < 0.95, FALSE)"""


@query("b_eligible", with_views(f"SELECT market_id FROM cat WHERE {ELIGIBLE_SQL}", extra={"cat": CATALOGUE_SQL}))
def b_eligible(spark, d):
    return catalogue(spark, d).filter(L.eligible(newest_event(spark, d).scalar())).select("market_id")


@query("q_daily_sample", with_views(
    f"""SELECT market_id FROM warned WHERE {ELIGIBLE_SQL} AND e % 6 <> 1 AND NOT list_has_any(warnings, [{REJECT_LIST}]) ORDER BY md5('2024-01-31:' || market_id), market_id LIMIT 20""", extra=LIVE_EXTRA))
def q_daily_sample(spark, d):
    now = newest_event(spark, d).scalar()
    pool = live_catalogue(spark, d).filter(L.eligible(now)).withColumn("warnings", L.warning_codes(now))
    sampled = live_catalogue(spark, d).filter("e % 6 = 1").select("market_id")
    return L.daily_sample(pool, sampled, "2024-01-31", 20).select("market_id")


MEDIANS = {"days_before_close": "days_before_close", "pct_lifetime_elapsed": "pct_lifetime_elapsed", "duration_days": "duration_days"}


@query("b_time_fill", with_views(
    f"""SELECT market_id, CASE WHEN no_end THEN f.days_before_close WHEN end_date <= {NOW_SQL} THEN 0.0 ELSE {r(f'(epoch_us(end_date) - epoch_us{NOW_SQL}) / 86400000000.0', 2)} END AS days_before_close,
          CASE WHEN no_end THEN f.pct_lifetime_elapsed ELSE {r(f'least(greatest((epoch_us{NOW_SQL} - epoch_us(created_at)) / CAST(epoch_us(end_date) - epoch_us(created_at) AS DOUBLE), 0.0), 1.0)', 4)} END AS pct_lifetime_elapsed,
          CASE WHEN no_end THEN f.duration_days ELSE floor((epoch_us(end_date) - epoch_us(created_at)) / 86400000000.0) END AS duration_days,
          {r('coalesce(CASE WHEN e % 4 <> 0 THEN volume / 100000.0 END, yes_price)', 4)} AS price_at_snapshot
        FROM lc, (SELECT {', '.join(f"{r(f'quantile_cont({c}, 0.5)', 4)} AS {c}" for c in MEDIANS)} FROM snapshots) f""", "snapshots", extra=LIVE_EXTRA))
def b_time_fill(spark, d):
    fill = cut(L.time_fill(V.snapshots(spark, d)))
    rows = live_catalogue(spark, d).withColumns({
        "last_price": F.when(F.col("e") % 4 != 0, F.col("volume") / 100000.0), "listed_price": F.col("yes_price")})
    out = L.fill_time_features(rows, fill, newest_event(spark, d).scalar())
    return out.select("market_id", *L.TIME_FEATURES, "price_at_snapshot")


@query("b_gap_to_market", with_views(
    f"SELECT row_key, {r('p_model_a - price_at_snapshot', 4)} AS gap_a, {r('p_model_b - price_at_snapshot', 4)} AS gap_b, CASE WHEN p_model_a >= 0.5 THEN 1 ELSE 0 END AS label_a FROM scored", "scored"))
def b_gap_to_market(spark, d):
    gap = lambda c: half_up(F.col(c) - F.col("price_at_snapshot"), 4)
    return V.scored(spark, d).select("row_key", gap("p_model_a").alias("gap_a"), gap("p_model_b").alias("gap_b"), (F.col("p_model_a") >= 0.5).cast("int").alias("label_a"))
