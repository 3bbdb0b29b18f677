"""Model and streaming queries. Results of a fit have no SQL counterpart; the table steps around it do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up
from tallycast.operators import leakage
from tallycast.operators import metrics as M
from tallycast.operators import modeling as ML
from tallycast.plans.feature_queries import stored_clean
from tallycast.plans.metric_queries import rnd
from tallycast.plans.oracle_views import r, with_views
from tallycast.plans.registry import query
from tallycast.session import cut
from tallycast.sources import views as V
from tallycast.sources.tables import scratch_path
from tallycast.streaming import jobs as R

NUMERIC = ML.NUMERIC_FEATURES


def parts(spark, d, numeric: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fit, holdout, test), prepared; fit carries its weights."""
    rows = cut(ML.prepare(stored_clean(spark, d), numeric))
    split = cut(leakage.holdout_split(rows.filter("split = 'train'"), V.markets_unsplit(spark, d), 0.2))
    fit = ML.training_table(split.filter("part = 'fit'"))
    return fit, split.filter("part = 'holdout'"), rows.filter("split LIKE 'test%'")


def report(model, fit_name: str, holdout: DataFrame, test: DataFrame) -> DataFrame:
    iso = ML.fit_calibrator(ML.scored(model, holdout))
    out = ML.calibrated(iso, ML.scored(model, test))
    return rnd(M.metric_table(out.withColumn("model", F.lit(fit_name)), ["model"]), "auc", "pr_auc", "log_loss", "brier")


@query("m_logistic")
def m_logistic(spark, d):
    fit, holdout, test = parts(spark, d, NUMERIC)
    best, _ = ML.search("logistic", NUMERIC, fit, holdout)
    return report(ML.fit_logistic(NUMERIC)(fit, best), "logistic", holdout, test)


@query("m_boosted")
def m_boosted(spark, d):
    """Given settings; the number of rounds is found on the holdout."""
    numeric = ML.with_trend_features(NUMERIC)
    fit, holdout, test = parts(spark, d, numeric)
    params = ML.check_params({"learning_rate": 0.1, "max_depth": 4, "min_child_weight": 20}, {"learning_rate", "max_depth", "min_child_weight"})
    both = fit.withColumn("is_holdout", F.lit(False)).unionByName(
        holdout.withColumns({"weight": F.lit(1.0), "is_holdout": F.lit(True)}))
    return report(ML.fit_boosted(numeric)(both, params), "boosted", holdout, test)


@query("m_forest")
def m_forest(spark, d):
    fit, holdout, test = parts(spark, d, NUMERIC)
    params = ML.check_params({"max_depth": 8, "min_samples_leaf": 20}, {"max_depth", "min_samples_leaf"})
    return report(ML.fit_forest(NUMERIC)(fit, params), "forest", holdout, test)


@query("m_forest_price_only")
def m_forest_price_only(spark, d):
    fit, holdout, test = parts(spark, d, ML.PRICE_ONLY)
    return report(ML.fit_forest(ML.PRICE_ONLY)(fit, {"max_depth": 5, "min_samples_leaf": 50}), "forest_price_only", holdout, test)


@query("m_importance")
def m_importance(spark, d):
    fit, _, _ = parts(spark, d, NUMERIC)
    model = ML.fit_forest(NUMERIC)(fit, {"max_depth": 5, "min_samples_leaf": 20})
    return ML.importance_table(model, fit, NUMERIC).orderBy(F.desc("importance"), "feature")


@query("m_point_model_folds")
def m_point_model_folds(spark, d):
    rows = cut(ML.prepare(stored_clean(spark, d).filter("split = 'train'"), ML.POINT_FEATURES))
    value = ML.cross_validated_auc(rows, ML.fit_logistic(ML.POINT_FEATURES), {"C": 1.0, "l1": False})
    return spark.createDataFrame([("logistic", value)], "model string, auc double")


@query("m_smoke")
def m_smoke(spark, d):
    """The outcomes of these tables are drawn without regard to prices, so the check learns another one: whether the
    price lies above one half, turned round for one row in ten by digest. The floor is the published one."""
    turned = F.conv(F.substring(F.md5(F.concat_ws(":", "market_id", "snapshot_timestamp")), 1, 4), 16, 10).cast("int") % 10 == 0
    outcome = ((F.col("price_at_snapshot") > 0.5) != turned).cast("int")
    rows = stored_clean(spark, d).withColumn("outcome", outcome)
    value = ML.smoke_fit(rows.filter("split = 'train'"), rows.filter("split LIKE 'test%'"), NUMERIC)
    return spark.createDataFrame([(value,)], "auc double")


@query("m_saved_model", "SELECT 0::BIGINT AS off, 0::BIGINT AS absent")
def m_saved_model(spark, d):
    """A saved model and calibrator score the test rows like those in memory: rows that differ or lack a score."""
    fit, holdout, test = parts(spark, d, ML.PRICE_ONLY)
    model = ML.fit_logistic(ML.PRICE_ONLY)(fit, {"C": 1.0, "l1": False})
    iso = ML.fit_calibrator(ML.scored(model, holdout))
    path = scratch_path(spark, "model")
    ML.save_model(model, iso, path)
    keys = ["market_id", "snapshot_timestamp"]
    again = ML.score_saved(path, test).select(*keys, F.col("p").alias("p_again"))
    both = ML.calibrated(iso, ML.scored(model, test)).select(*keys, "p").join(again, keys, "left")
    return both.agg(F.count_if(F.abs(F.col("p") - F.col("p_again")) > 1e-12).alias("off"), F.count_if(F.col("p_again").isNull()).alias("absent"))


MEDIAN_SQL = """SELECT part, count(*) AS n, count(*) FILTER (x = med) AS at_median, round(sum(x), 4) AS total FROM (
    SELECT CASE WHEN k % 5 = 0 THEN 'test' ELSE 'train' END AS part, coalesce(v, med) AS x, med FROM t, (SELECT median(v) AS med FROM t WHERE k % 5 <> 0)) GROUP BY part"""


@query("m_median_fill", with_views(MEDIAN_SQL, extra={
    "t": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DOUBLE END AS v FROM orders"}))
def m_median_fill(spark, d):
    t = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("double")).alias("v"))
    train, test = ML.fill_medians(t.filter("k % 5 <> 0"), t.filter("k % 5 = 0"), ["v"])
    med = train.agg(F.percentile("v", 0.5).alias("m"))  # filling with the median keeps it
    out = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == med.scalar()).alias("at_median"), F.round(F.sum("v"), 4).alias("total"))


@query("m_ordinal_codes", """SELECT part, category, code, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS part,
    CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'unseen' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS category FROM customer) t
    LEFT JOIN (SELECT c_mktsegment AS seg, (row_number() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 11 <> 0)) ON seg = category,
    LATERAL (SELECT coalesce(c, -1.0::DOUBLE) AS code) GROUP BY ALL""")
def m_ordinal_codes(spark, d):
    k = F.col("c_custkey")
    category = F.when((k % 5 == 0) & (k % 2 == 0), "unseen").when(k % 11 == 0, None).otherwise(F.col("c_mktsegment"))
    t = V.table(spark, d, "customer").select(k, category.alias("category"))
    train, test = ML.ordinal_category(t.filter("c_custkey % 5 <> 0"), t.filter("c_custkey % 5 = 0"))
    out = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return out.groupBy("part", "category", F.col("category_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("m_category_codes", "SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code, c_mktsegment AS category FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def m_category_codes(spark, d):
    return ML.category_codes(V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("category")))


RARE_SQL = """SELECT 'train' AS part, CASE WHEN category IN (SELECT category FROM kept) THEN category ELSE 'other' END AS category, count(*) AS n FROM t WHERE market_id % 5 <> 0 GROUP BY ALL
    UNION ALL SELECT 'test', CASE WHEN category IN (SELECT category FROM kept) THEN category ELSE 'other' END, count(*) FROM t WHERE market_id % 5 = 0 GROUP BY ALL"""


@query("m_rare_categories", with_views(RARE_SQL, extra={
    "t": "SELECT p_partkey AS market_id, p_brand || p_type AS category FROM part",
    "kept": "SELECT category FROM t WHERE market_id % 5 <> 0 GROUP BY category HAVING count(*) / (SELECT count(*) FROM t WHERE market_id % 5 <> 0) >= 0.02"}))
def m_rare_categories(spark, d):
    t = V.table(spark, d, "part").select(F.col("p_partkey").alias("market_id"), F.concat("p_brand", "p_type").alias("category"))
    train, test = ML.collapse_rare(t.filter("market_id % 5 <> 0"), t.filter("market_id % 5 = 0"))
    counted = lambda df, n: df.groupBy(F.lit(n).alias("part"), "category").agg(F.count(F.lit(1)).alias("n"))
    return counted(train, "train").unionByName(counted(test, "test"))


@query("m_row_weights", with_views(
    f"""SELECT market_id, outcome, count(*) AS n, {r('max(w * total / (2.0::DOUBLE * CASE WHEN outcome = 1 THEN pos ELSE total - pos END))', 6)} AS weight FROM (
          SELECT market_id, outcome, (SELECT count(*)::DOUBLE / count(DISTINCT market_id) FROM scored) / count(*) OVER (PARTITION BY market_id) AS w,
                 count(*) OVER () AS total, sum(outcome) OVER () AS pos FROM scored) GROUP BY ALL""", "scored"))
def m_row_weights(spark, d):
    w = ML.row_weights(V.scored(spark, d).select("market_id", "outcome"))
    return rnd(w.groupBy("market_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")), "weight")


@query("m_folds", "SELECT o_custkey AS market_id, CAST(CAST(('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n FROM orders GROUP BY ALL")
def m_folds(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("market_id"))
    return ML.folds(o).groupBy("market_id", "fold").agg(F.count(F.lit(1)).alias("n"))


KEYWORDS = {"weather": ["storm", "Rainfall", "drought"], "space": ["rocket", "orbit"], "chess": ["Grandmaster", "endgame", "opening"]}
WORDS = [w for ws in KEYWORDS.values() for w in ws] + ["harvest"]
KEYWORD_CASE = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'''contains(q, '{w.lower()}')''' for w in ws)} THEN '{c}'" for c, ws in KEYWORDS.items()) + " ELSE 'other' END"


@query("m_categorise", f"""SELECT market_id, CASE WHEN q <> '' THEN {KEYWORD_CASE} END AS category FROM (
    SELECT event_id AS market_id, lower(CASE WHEN event_id % 97 = 0 THEN '' ELSE 'Will ' || [{', '.join(f"'{w}'" for w in WORDS)}][event_id % {len(WORDS)} + 1] || ' matter for ' || event_type || '?' END) AS q FROM events)""")
def m_categorise(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("event_id") % len(WORDS) + 1).cast("int"))
    text = F.when(F.col("event_id") % 97 == 0, "").otherwise(F.concat(F.lit("Will "), word, F.lit(" matter for "), "event_type", F.lit("?")))
    questions = V.table(spark, d, "events").select(F.col("event_id").alias("market_id"), text.alias("question"))
    return questions.select("market_id", ML.keyword_category(F.col("question"), KEYWORDS).alias("category"))


# ---------------------------------------------------------------- streams

def event_stream(spark, d) -> DataFrame:
    schema = V.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("r_incremental_ingest", "SELECT DISTINCT user_id AS market_id FROM events")
def r_incremental_ingest(spark, d):
    stream = event_stream(spark, d).select(F.col("user_id").alias("market_id"), F.col("ts").cast("timestamp").alias("end_date"))
    return R.run_to_table(R.ingest(stream, "market_id", "end_date"), spark).select("market_id")


ARRIVALS_SQL = """WITH a AS (SELECT user_id AS market_id, event_id % 3 AS run, TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 100 AS INTEGER)) AS end_date FROM events
      WHERE user_id % 4 = 0 OR (user_id % 4 = 1 AND event_id % 3 >= 1) OR (user_id % 4 = 2 AND event_id % 3 = 2) OR (user_id % 4 = 3 AND event_id % 3 = 0)),
    seen AS (SELECT r.run, (SELECT max(end_date) FROM a WHERE a.run < r.run) - INTERVAL 30 DAY AS low FROM (SELECT DISTINCT run FROM a) r)
    SELECT market_id, CAST(min(run) AS BIGINT) AS run FROM a JOIN seen USING (run) WHERE low IS NULL OR end_date >= low GROUP BY market_id"""


@query("r_ingest_in_runs", ARRIVALS_SQL)
def r_ingest_in_runs(spark, d):
    """Three runs of one checkpoint: repeated markets, late closings within the look-back, and ones beyond it."""
    run, cohort = F.col("event_id") % 3, F.col("user_id") % 4
    arrives = (cohort == 0) | ((cohort == 1) & (run >= 1)) | ((cohort == 2) & (run == 2)) | ((cohort == 3) & (run == 0))
    end = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("user_id") % 100).cast("int"))).cast("timestamp")
    rows = V.table(spark, d, "events").filter(arrives).select(F.col("user_id").alias("market_id"), run.cast("long").alias("run"), end.alias("end_date"))
    landing, path, out = scratch_path(spark, "landing"), scratch_path(spark, "ingest"), None
    for k in range(3):
        rows.filter(F.col("run") == k).write.mode("append").parquet(landing)
        out = R.run_to_table(R.ingest(spark.readStream.schema(rows.schema).parquet(landing), "market_id", "end_date"), spark, path)
    return out.select("market_id", "run")


@query("r_lookup_log", """SELECT source, market_id, lookup_id FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'sample' ELSE 'search' END AS source, user_id AS market_id, event_id AS lookup_id,
    row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def r_lookup_log(spark, d):
    source = F.when(F.col("event_id") % 2 == 0, "sample").otherwise("search")
    stream = event_stream(spark, d).select(
        source.alias("source"), F.col("user_id").alias("market_id"), F.col("event_id").alias("lookup_id"), "ts", F.lit("r1").alias("release"))
    return R.first_of_log(R.append_log(stream, spark)).select("source", "market_id", "lookup_id")


@query("r_resolution_stream", """SELECT event_id AS lookup_id, user_id AS market_id, CASE WHEN user_id % 4 = 0 THEN 'open' WHEN bal >= 5000 THEN 'resolved' ELSE 'ambiguous' END AS status
    FROM events LEFT JOIN (SELECT c_custkey, c_acctbal AS bal FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = user_id""")
def r_resolution_stream(spark, d):
    closed = V.table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(
        F.col("c_custkey").alias("market_id"), F.when(F.col("c_acctbal") >= 5000, 0.99).otherwise(0.5).alias("yes_price"))
    stream = event_stream(spark, d).select(F.col("event_id").alias("lookup_id"), F.col("user_id").alias("market_id"))
    return R.run_to_table(R.resolve(stream, closed), spark).select("lookup_id", "market_id", "status")


@query("r_first_lookups_in_runs", """SELECT source, market_id, lookup_id FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'sample' ELSE 'search' END AS source, user_id AS market_id, event_id AS lookup_id,
    row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def r_first_lookups_in_runs(spark, d):
    """Files arrive in three runs of one checkpoint; every second batch compacts the changes."""
    source = F.when(F.col("event_id") % 2 == 0, "sample").otherwise("search")
    rows = V.table(spark, d, "events").select(source.alias("source"), F.col("user_id").alias("market_id"), F.col("event_id").alias("lookup_id"), "ts", F.lit("r1").alias("release"))
    landing, state = scratch_path(spark, "landing"), scratch_path(spark, "first")
    out = None
    for arrivals in ((0, 1), (2,), (3, 4)):
        for k in arrivals:
            rows.filter(F.col("lookup_id") % 5 == k).write.mode("append").parquet(landing)
        out = R.keep_first(spark.readStream.schema(rows.schema).parquet(landing), spark, state, compact_every=2)
    return out.select("source", "market_id", "lookup_id")


@query("r_resolution_later", """SELECT event_id AS lookup_id, user_id AS market_id, CASE WHEN bal IS NULL THEN 'open' WHEN bal >= 5000 THEN 'resolved' ELSE 'ambiguous' END AS status
    FROM events LEFT JOIN (SELECT c_custkey, c_acctbal AS bal FROM customer WHERE c_custkey % 8 <> 0) ON c_custkey = user_id""")
def r_resolution_later(spark, d):
    """Open lookups of a first run are looked up again when the catalogue has closed more markets."""
    price = F.when(F.col("c_acctbal") >= 5000, 0.99).otherwise(0.5).alias("yes_price")
    closed = V.table(spark, d, "customer").filter("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("market_id"), price)
    stream = event_stream(spark, d).select(F.col("event_id").alias("lookup_id"), F.col("user_id").alias("market_id"))
    known = R.run_to_table(R.resolve(stream, closed.filter("market_id % 4 <> 0")), spark)
    return R.resolve_later(known, closed).select("lookup_id", "market_id", "status")
