"""Descriptive, window, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles, half_up
from tallycast.functions.running import hash_rank, running_rank
from tallycast.operators import explore as X
from tallycast.operators import slices as S
from tallycast.operators.live import draw_order
from tallycast.operators.metrics import auc
from tallycast.plans.metric_queries import long_scores, market_means, quantile_sql, rnd, MARKET_SQL
from tallycast.plans.oracle_views import r, with_views
from tallycast.plans.registry import query
from tallycast.plans.sql_parts import auc_sql
from tallycast.operators.snapshots import rolling_columns
from tallycast.sources import views as V

DESCRIBED = ["duration_days", "total_volume", "yes_final_price"]


def describe_sql(src: str, cols: list[str], keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"""SELECT {k}'{c}' AS "column", count({c}) AS n, {r(f'avg({c})', 6)} AS mean, {r(f'stddev_samp({c})', 6)} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
            {r(f'quantile_cont({c}, 0.25)', 6)} AS q25, {r(f'quantile_cont({c}, 0.5)', 6)} AS q50, {r(f'quantile_cont({c}, 0.75)', 6)} AS q75
            FROM {src} {f'GROUP BY {keys}' if keys else ''}""" for c in cols)


@query("d_describe", with_views(describe_sql("markets_unsplit", DESCRIBED), "markets_unsplit"))
def d_describe(spark, d):
    return rnd(X.describe(V.markets_unsplit(spark, d), DESCRIBED), "mean", "std", "q25", "q50", "q75")


@query("d_describe_by_category", with_views(describe_sql("scored", ["price_at_snapshot", "total_volume"], "category"), "scored"))
def d_describe_by_category(spark, d):
    return rnd(X.describe(V.scored(spark, d), ["price_at_snapshot", "total_volume"], ["category"]), "mean", "std", "q25", "q50", "q75")


@query("d_summary_stats", f"""SELECT min(o_totalprice) AS lo, {r('quantile_cont(o_totalprice, 0.5)', 4)} AS median, {r('avg(o_totalprice)', 4)} AS mean, max(o_totalprice) AS hi FROM orders""")
def d_summary_stats(spark, d):
    o = V.table(spark, d, "orders").select("o_totalprice")
    median = exact_percentiles(o, [], "o_totalprice", [0.5]).select(half_up("value", 4)).scalar()
    return o.agg(F.min("o_totalprice").alias("lo"), half_up(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("hi")).withColumn("median", median)


@query("d_value_counts", f"SELECT event_type, count(*) AS n, {r('count(*) / (SELECT count(*) FROM events)', 6)} AS share FROM events GROUP BY event_type")
def d_value_counts(spark, d):
    return rnd(X.value_counts(V.table(spark, d, "events"), "event_type"), "share")


RANGES = [("1k-10k", 1e3, 1e4), ("10k-100k", 1e4, 1e5), ("100k-1M", 1e5, 1e6), ("1M+", 1e6, None)]


@query("d_range_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS range, count(*) FILTER (o_totalprice >= {lo} {f'AND o_totalprice < {hi}' if hi else ''}) AS n FROM orders" for n, lo, hi in RANGES))
def d_range_counts(spark, d):
    return X.range_counts(V.table(spark, d, "orders"), "o_totalprice", RANGES)


PROBS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query("d_percentiles", with_views(
    " UNION ALL ".join(f"SELECT model, {p}::DOUBLE AS prob, {r(f'quantile_cont(p, {p})', 6)} AS value FROM long_scores GROUP BY model" for p in PROBS), "long_scores"))
def d_percentiles(spark, d):
    return rnd(exact_percentiles(long_scores(spark, d), ["model"], "p", PROBS), "value")


NULLABLE = ["market_id", "clob_token_id", "question", "start_date", "end_date", "closed_time", "duration_days", "total_volume", "yes_final_price", "outcome", "category"]


@query("d_null_counts", with_views(
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, {r(f'count(*) FILTER ({c} IS NULL) / count(*)', 6)} AS share FROM markets_unsplit""" for c in NULLABLE), "markets_unsplit"))
def d_null_counts(spark, d):
    return rnd(X.null_counts(V.markets_unsplit(spark, d), NULLABLE), "share")


@query("d_any_null", with_views(
    """SELECT '7d' AS feature_group, count(*) FILTER (price_mean_7d IS NULL OR price_trend_7d IS NULL) AS rows, count(DISTINCT CASE WHEN price_mean_7d IS NULL OR price_trend_7d IS NULL THEN market_id END) AS markets FROM raw_snapshots
       UNION ALL SELECT '14d', count(*) FILTER (price_mean_14d IS NULL), count(DISTINCT CASE WHEN price_mean_14d IS NULL THEN market_id END) FROM raw_snapshots""", "raw_snapshots"))
def d_any_null(spark, d):
    return X.any_null(V.raw_snapshots(spark, d), {"7d": ["price_mean_7d", "price_trend_7d"], "14d": ["price_mean_14d"]})


@query("d_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d_duplicates(spark, d):
    return X.duplicates(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("d_split_overlap", "SELECT l_orderkey AS market_id FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'O') AND bool_or(l_linestatus <> 'O')")
def d_split_overlap(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("market_id"), F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("split"))
    return X.split_overlap(rows)


INPUTS = ["price_at_snapshot", "days_before_close", "pct_lifetime_elapsed", "duration_days", *rolling_columns()]
CORR = ["price_at_snapshot", "p_model_a", "p_model_b", "duration_days", "days_before_close", "pct_lifetime_elapsed", "total_volume", "outcome"]
TARGET_CORR = [*INPUTS, "price_deviation_from_half", "total_volume", "log_volume"]


@query("d_correlations", with_views(
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS r FROM scored" for i, a in enumerate(CORR) for b in CORR[i + 1:]), "scored"))
def d_correlations(spark, d):
    return rnd(X.correlations(V.scored(spark, d), CORR), "r")


@query("d_high_correlations", with_views(
    f"SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS r FROM snapshots''' for i, a in enumerate(INPUTS) for b in INPUTS[i + 1:])}) WHERE abs(r) > 0.85", "snapshots"))
def d_high_correlations(spark, d):
    c = rnd(X.correlations(V.snapshots(spark, d), INPUTS), "r")
    return c.filter(F.abs("r") > 0.85).orderBy(F.abs("r").desc())


@query("d_target_correlations", with_views(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'corr({c}, outcome)', 6)} AS r FROM snapshots" for c in TARGET_CORR), "snapshots"))
def d_target_correlations(spark, d):
    return rnd(X.target_correlations(V.snapshots(spark, d), TARGET_CORR, "outcome"), "r").orderBy(F.abs("r").desc())


@query("d_markets_per_month", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n FROM orders GROUP BY 1")
def d_markets_per_month(spark, d):
    return V.table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("d_histogram", """WITH s AS (SELECT log10(o_totalprice) AS v FROM orders), e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS total FROM s)
    SELECT bin, n, {edge} AS edge, {density} AS density FROM (
      SELECT CAST(least(greatest(floor((v - lo) / ((hi - lo) / 50)), 0), 49) AS BIGINT) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(total) AS total FROM s, e GROUP BY 1)""".format(
    edge=r("lo + bin * ((hi - lo) / 50)", 6), density=r("n / (total * ((hi - lo) / 50))", 6)))
def d_histogram(spark, d):
    return rnd(X.histogram(V.table(spark, d, "orders"), F.log10("o_totalprice"), 50), "edge", "density")


@query("d_histogram_by_outcome", with_views(
    f"""SELECT outcome, bin, n, {r('bin * (1.0::DOUBLE / 50)', 6)} AS edge, {r('n / (sum(n) OVER (PARTITION BY outcome) * (1.0::DOUBLE / 50))', 6)} AS density FROM (
          SELECT outcome, CAST(least(greatest(floor((price_at_snapshot - 0.0) / (1.0::DOUBLE / 50)), 0), 49) AS BIGINT) AS bin, count(*) AS n FROM scored GROUP BY ALL)""", "scored"))
def d_histogram_by_outcome(spark, d):
    return rnd(X.histogram(V.scored(spark, d), F.col("price_at_snapshot"), 50, ["outcome"], 0.0, 1.0), "edge", "density")


@query("d_snapshots_per_market", with_views(
    f"SELECT n_snapshots, count(*) AS markets FROM (SELECT market_id, count(*) AS n_snapshots FROM snapshots GROUP BY 1) GROUP BY 1", "snapshots"))
def d_snapshots_per_market(spark, d):
    per = V.snapshots(spark, d).groupBy("market_id").agg(F.count(F.lit(1)).alias("n_snapshots"))
    return per.groupBy("n_snapshots").agg(F.count(F.lit(1)).alias("markets"))


def above_sql(n: int) -> str:
    return " + ".join(f"CASE WHEN pct_lifetime_elapsed > lo + {k} * ((hi - lo) / {n}) THEN 1 ELSE 0 END" for k in range(1, n))


@query("d_null_by_decile", with_views(
    f"""SELECT CAST({above_sql(10)} AS INTEGER) AS bin, count(*) AS n, {r('avg(CASE WHEN price_mean_7d IS NULL OR price_at_snapshot > 0.9 THEN 1 ELSE 0 END)', 6)} AS null_share
        FROM raw_snapshots, (SELECT min(pct_lifetime_elapsed) AS lo, max(pct_lifetime_elapsed) AS hi FROM raw_snapshots) GROUP BY 1""", "raw_snapshots"))
def d_null_by_decile(spark, d):
    holed = V.raw_snapshots(spark, d).withColumn("x", F.when(F.col("price_at_snapshot") <= 0.9, F.col("price_mean_7d")))
    return rnd(X.null_share_by_decile(holed, "pct_lifetime_elapsed", "x"), "null_share")


@query("d_category_outcome_rate", with_views(
    f"SELECT category, {r('avg(outcome)', 6)} AS yes_rate, count(*) AS markets FROM markets_unsplit GROUP BY category", "markets_unsplit"))
def d_category_outcome_rate(spark, d):
    return rnd(V.markets_unsplit(spark, d).groupBy("category").agg(F.avg("outcome").alias("yes_rate"), F.count(F.lit(1)).alias("markets")), "yes_rate")


CONCORD = "SELECT model, market_id, avg(CASE WHEN (p > 0.5) = (outcome = 1) THEN 1 ELSE 0 END) AS concordance, count(*) AS n FROM long_scores GROUP BY ALL"


@query("d_concordance", with_views(f"SELECT model, market_id, {r('concordance', 6)} AS concordance, n FROM ({CONCORD}) WHERE concordance < 0.3", "long_scores"))
def d_concordance(spark, d):
    return rnd(X.concordance(long_scores(spark, d), ["model"]).filter("concordance < 0.3"), "concordance")


@query("d_first_cross", with_views(
    f"""SELECT model, {r('quantile_cont(f, 0.5)', 6)} AS median_cross, {r('avg(CASE WHEN f IS NULL THEN 1 ELSE 0 END)', 6)} AS never_rate FROM (
          SELECT model, market_id, min(CASE WHEN (p > 0.5) = (outcome = 1) THEN pct_lifetime_elapsed END) AS f FROM long_scores GROUP BY ALL) GROUP BY model""", "long_scores"))
def d_first_cross(spark, d):
    per = X.first_correct_cross(long_scores(spark, d, "pct_lifetime_elapsed"), ["model"])
    never = per.groupBy("model").agg(F.avg(F.col("first_cross").isNull().cast("int")).alias("never_rate"))
    median = exact_percentiles(per, ["model"], "first_cross", [0.5]).select("model", F.col("value").alias("median_cross"))
    return rnd(never.join(median, "model"), "median_cross", "never_rate")


ERRORS_SQL = """count(*) AS n, {wr} AS wrong_rate, count(*) FILTER (p > 0.8 AND outcome = 0) AS sure_yes_wrong, count(*) FILTER (p < 0.2 AND outcome = 1) AS sure_no_wrong,
    {sr} AS sure_wrong_rate, {sh} AS shared_with_market""".format(
    wr=r("avg(CASE WHEN (p > 0.5) <> (outcome = 1) THEN 1 ELSE 0 END)", 6),
    sr=r("avg(CASE WHEN (p > 0.8 AND outcome = 0) OR (p < 0.2 AND outcome = 1) THEN 1 ELSE 0 END)", 6),
    sh=r("count(*) FILTER (((p > 0.8 AND outcome = 0) OR (p < 0.2 AND outcome = 1)) AND (price_at_snapshot > 0.5) <> (outcome = 1)) / nullif(count(*) FILTER ((p > 0.8 AND outcome = 0) OR (p < 0.2 AND outcome = 1)), 0)", 6))
ERROR_RATES = ["wrong_rate", "sure_wrong_rate", "shared_with_market"]


@query("d_error_taxonomy", with_views(f"SELECT model, category, {ERRORS_SQL} FROM long_scores GROUP BY ALL", "long_scores"))
def d_error_taxonomy(spark, d):
    return rnd(X.error_rates(long_scores(spark, d, "category", "price_at_snapshot"), ["model", "category"]), *ERROR_RATES)


QUARTER_SQL = "'q' || (least(greatest(floor(pct_lifetime_elapsed * 4), 0), 3) + 1)::INT"


@query("d_error_report", with_views(
    f"""SELECT model, 'overall' AS dimension, NULL::VARCHAR AS value, {ERRORS_SQL} FROM long_scores GROUP BY model
        UNION ALL SELECT model, 'category', category, {ERRORS_SQL} FROM long_scores GROUP BY model, category
        UNION ALL SELECT model, 'quarter', {QUARTER_SQL}, {ERRORS_SQL} FROM long_scores GROUP BY ALL""", "long_scores"))
def d_error_report(spark, d):
    """Errors overall, by category and by quarter of a market's lifetime."""
    quarter = F.concat(F.lit("q"), (S.equal_width(F.col("pct_lifetime_elapsed"), F.lit(0.0), F.lit(1.0), 4) + 1).cast("string"))
    df = long_scores(spark, d, "category", "price_at_snapshot", "pct_lifetime_elapsed").withColumn("quarter", quarter)
    return rnd(X.error_report(df, "model", ["category", "quarter"]), *ERROR_RATES)


@query("d_errors_by_volume", with_views(
    f"SELECT model, bin, {ERRORS_SQL} FROM cut GROUP BY ALL", "scored",
    extra={"q": quantile_sql("scored", "total_volume", 4),
           "cut": "SELECT *, 'model_a' AS model, p_model_a AS p FROM q UNION ALL SELECT *, 'model_b', p_model_b FROM q"}))
def d_errors_by_volume(spark, d):
    binned = S.quantile_bins(V.scored(spark, d), "total_volume", 4)
    long = V.long_scores(binned, ["outcome", "price_at_snapshot", "bin"], {"model_a": "p_model_a", "model_b": "p_model_b"})
    return rnd(X.error_rates(long, ["model", "bin"]), *ERROR_RATES)


DIS_SQL = f"""SELECT *, CASE WHEN (model_prob >= 0.5) = (outcome = 1) AND (market_prob >= 0.5) <> (outcome = 1) THEN 'model_only_right'
      WHEN (model_prob >= 0.5) <> (outcome = 1) AND (market_prob >= 0.5) = (outcome = 1) THEN 'market_only_right'
      WHEN (model_prob >= 0.5) = (outcome = 1) THEN 'both_right' ELSE 'both_wrong' END AS kind
    FROM (SELECT market_id, min_by(outcome, (snapshot_timestamp, row_key)) AS outcome, min(category) AS category, max(total_volume) AS total_volume,
            {r('avg(p_model_a)', 9)} AS model_prob, {r('avg(price_at_snapshot)', 9)} AS market_prob FROM scored GROUP BY market_id)"""


def disagreement(spark, d) -> DataFrame:
    return X.disagreements(V.scored(spark, d), "p_model_a", order=("snapshot_timestamp", "row_key"))


@query("d_disagreement_counts", with_views("SELECT kind, count(*) AS markets FROM dis GROUP BY kind", "scored", extra={"dis": DIS_SQL}))
def d_disagreement_counts(spark, d):
    return disagreement(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("markets"))


@query("f_top_disagreements", with_views(
    """SELECT market_id, outcome, category, total_volume, model_prob, market_prob, kind FROM (
         SELECT *, row_number() OVER (PARTITION BY kind ORDER BY total_volume DESC, market_id) AS rn FROM dis WHERE kind IN ('model_only_right', 'market_only_right')) WHERE rn <= 5""",
    "scored", extra={"dis": DIS_SQL}))
def f_top_disagreements(spark, d):
    return X.top_per_class(disagreement(spark, d), ["model_only_right", "market_only_right"], 5, [F.desc("total_volume"), F.asc("market_id")])


CLASS_SQL = """CASE WHEN abs(p - outcome) < 0.2 THEN 'well' WHEN p < 0.35 AND outcome = 1 THEN 'poor_yes' WHEN p > 0.65 AND outcome = 0 THEN 'poor_no' ELSE 'middling' END"""


@query("d_prediction_classes", with_views(
    f"""SELECT class, category, n, {r('n / sum(n) OVER (PARTITION BY class)', 6)} AS share FROM (
          SELECT class, category, count(*) AS n FROM (SELECT {CLASS_SQL} AS class, category FROM
            (SELECT market_id, category, min(outcome) AS outcome, {r('avg(p_model_a)', 9)} AS p FROM scored GROUP BY market_id, category)) GROUP BY class, category)""", "scored"))
def d_prediction_classes(spark, d):
    per = V.scored(spark, d).groupBy("market_id", "category").agg(F.min("outcome").alias("outcome"), half_up(F.avg("p_model_a"), 9).alias("p"))
    return rnd(X.value_counts(per.withColumn("class", X.prediction_class()), "category", ["class"]), "share")


@query("f_widest_spread", with_views(
    f"""SELECT row_key, {r('spread', 6)} AS spread FROM (SELECT row_key, greatest(p_model_a, p_model_b, price_at_snapshot) - least(p_model_a, p_model_b, price_at_snapshot) AS spread FROM scored)
        ORDER BY spread DESC, row_key LIMIT 10""", "scored"))
def f_widest_spread(spark, d):
    df = V.scored(spark, d).select("row_key", half_up(X.spread(["p_model_a", "p_model_b", "price_at_snapshot"]), 6).alias("spread"))
    return df.orderBy(F.desc("spread"), "row_key").limit(10)


@query("c_question_lookup", with_views(
    """SELECT t.market_id, t.n, m.question FROM (SELECT market_id, count(*) AS n FROM snapshots GROUP BY 1 ORDER BY n DESC, market_id LIMIT 10) t
       LEFT JOIN (SELECT DISTINCT market_id, question FROM snapshots) m ON m.market_id = t.market_id""", "snapshots"))
def c_question_lookup(spark, d):
    snaps = V.snapshots(spark, d)
    top = snaps.groupBy("market_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "market_id").limit(10)
    return top.join(snaps.select("market_id", "question").distinct(), "market_id", "left")


@query("d_ensemble", with_views(
    f"SELECT {r('auc', 6)} AS auc FROM {auc_sql('t', [])}", "scored",
    extra={"t": f"SELECT outcome, {r('(p_model_a + p_model_b + price_at_snapshot) / 3.0', 9)} AS p FROM scored"}))
def d_ensemble(spark, d):
    df = V.scored(spark, d).withColumn("p", half_up(X.mean_of(["p_model_a", "p_model_b", "price_at_snapshot"]), 9))
    return rnd(auc(df, []), "auc")


@query("f_category_heads", with_views(
    f"""SELECT * FROM (SELECT category, {r('avg(auc)', 6)} AS mean_auc FROM {auc_sql('long_scores', ['category', 'model'])} GROUP BY category) ORDER BY mean_auc, category LIMIT 3""", "long_scores"))
def f_category_heads(spark, d):
    by = auc(long_scores(spark, d, "category"), ["category", "model"]).groupBy("category").agg(half_up(F.avg("auc"), 6).alias("mean_auc"))
    return by.orderBy("mean_auc", "category").limit(3)


@query("f_category_tails", with_views(
    f"""SELECT * FROM (SELECT category, {r('avg(auc)', 6)} AS mean_auc FROM {auc_sql('long_scores', ['category', 'model'])} GROUP BY category) ORDER BY mean_auc DESC, category LIMIT 3""", "long_scores"))
def f_category_tails(spark, d):
    by = auc(long_scores(spark, d, "category"), ["category", "model"]).groupBy("category").agg(half_up(F.avg("auc"), 6).alias("mean_auc"))
    return by.orderBy(F.desc("mean_auc"), "category").limit(3)


@query("e_row_index", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) - 1 AS idx FROM lineitem""")
def e_row_index(spark, d):
    line = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    ranked = running_rank(line.withColumn("lvl", F.date_trunc("year", "l_shipdate")), ["l_orderkey"], ["lvl"],
                          ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"], "pos")
    return ranked.withColumn("idx", F.col("pos") - 1).drop("pos", "tot_pos")


@query("f_fixed_sample", "SELECT event_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 2000")
def f_fixed_sample(spark, d):
    return V.table(spark, d, "events").select("event_id").orderBy(*draw_order("42", "event_id")).limit(2000)


@query("f_fraction_sample", "SELECT * FROM events WHERE CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) < 429496730")
def f_fraction_sample(spark, d):
    """A tenth of the rows by the digest of the id, so the sample does not depend on partitions."""
    return X.fraction_sample(V.table(spark, d, "events"), "event_id", 0.1, "42")


@query("f_draw_order", """SELECT market_id FROM (SELECT user_id AS market_id, md5('2024-01-31:' || user_id) AS k FROM events GROUP BY user_id)
    WHERE market_id NOT IN (SELECT user_id FROM events WHERE event_id % 100 = 0) ORDER BY k, market_id LIMIT 20""")
def f_draw_order(spark, d):
    e = V.table(spark, d, "events")
    sampled = e.filter("event_id % 100 = 0").select(F.col("user_id").alias("market_id")).distinct()
    pool = e.select(F.col("user_id").alias("market_id")).distinct().join(sampled, "market_id", "left_anti")
    return pool.orderBy(*draw_order("2024-01-31")).limit(20)


@query("f_market_split", with_views(
    """SELECT market_id, CASE WHEN pos <= floor(n * 0.15::DOUBLE) THEN 'val' WHEN pos - floor(n * 0.15::DOUBLE) <= floor((n - floor(n * 0.15::DOUBLE)) * 0.2::DOUBLE) THEN 'cal' ELSE 'fit' END AS part
       FROM (SELECT market_id, row_number() OVER (ORDER BY md5(CAST(market_id AS VARCHAR)), market_id) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT market_id FROM scored))""", "scored"))
def f_market_split(spark, d):
    ranked = hash_rank(V.scored(spark, d).select("market_id").distinct(), "market_id", "pos")
    n_val = F.floor(F.col("tot_pos") * 0.15)
    n_cal = F.floor((F.col("tot_pos") - n_val) * 0.2)
    part = F.when(F.col("pos") <= n_val, "val").when(F.col("pos") - n_val <= n_cal, "cal").otherwise("fit")
    return ranked.select("market_id", part.alias("part"))


@query("f_sort_by_size", f"SELECT user_id, {r('sum(value) - 3000', 2)} AS gap FROM events GROUP BY 1 ORDER BY abs(gap) DESC, user_id LIMIT 20")
def f_sort_by_size(spark, d):
    df = V.table(spark, d, "events").groupBy("user_id").agg(half_up(F.sum("value") - 3000, 2).alias("gap"))
    return df.orderBy(F.abs("gap").desc(), "user_id").limit(20)


@query("g_union_by_name", "SELECT event_id, user_id, NULL::VARCHAR AS note FROM events WHERE value > 200 UNION ALL SELECT event_id, user_id, 'low' FROM events WHERE value < 1")
def g_union_by_name(spark, d):
    e = V.table(spark, d, "events").select("event_id", "user_id", "value")
    low = e.filter("value < 1").withColumn("note", F.lit("low"))
    return e.filter("value > 200").unionByName(low, allowMissingColumns=True).drop("value")


@query("g_id_sets", """SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'only_first', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def g_id_sets(spark, d):
    a = V.table(spark, d, "orders").select("o_custkey")
    b = V.table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")
    count = F.count(F.lit(1)).alias("n")
    return a.intersect(b).agg(count).select(F.lit("both").alias("side"), "n").unionByName(
        a.subtract(b).agg(count).select(F.lit("only_first").alias("side"), "n"))


@query("g_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def g_distinct(spark, d):
    return V.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
