"""Metric, calibration, bootstrap and slice queries over the scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles, half_up
from tallycast.operators import backtest as B
from tallycast.operators import bootstrap as BS
from tallycast.operators import metrics as M
from tallycast.operators import slices as S
from tallycast.plans.feature_queries import stored_clean
from tallycast.plans.oracle_views import r, with_views
from tallycast.plans.registry import query
from tallycast.plans.sql_parts import (
    AUC_EXPR, auc_sql, case_buckets, draws_sql, groups_sql, metric_sql, ranked_sql, rounded, slice_sql,
)
from tallycast.sources import views as V

MODELS = {"model_a": "p_model_a", "model_b": "p_model_b"}


def rnd(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: half_up(c, digits) for c in cols})


def long_scores(spark, d, *keep: str) -> DataFrame:
    return V.long_scores(V.scored(spark, d), ["market_id", "outcome", *keep])


METRICS = ["auc", "pr_auc", "log_loss", "brier"]


@query("h_metrics", with_views(f"SELECT model, n, {rounded(METRICS)} FROM {metric_sql('long_scores', ['model'])}", "long_scores"))
def h_metrics(spark, d):
    return rnd(M.metric_table(long_scores(spark, d), ["model"]), *METRICS)


@query(
    "h_auc_by_market_duration",
    with_views(
        slice_sql("cut", ["model", "bucket"]), "long_scores",
        extra={"cut": f"SELECT *, {case_buckets('duration_days', S.DURATION, True)} AS bucket FROM long_scores"},
    ),
)
def h_auc_by_market_duration(spark, d):
    df = long_scores(spark, d, "duration_days").withColumn("bucket", S.closed("duration_days", S.DURATION))
    return rnd(S.auc_by(df, ["model", "bucket"]), "auc")


WEIGHTED = "SELECT *, (SELECT count(*)::DOUBLE / count(DISTINCT market_id) FROM scored) / count(*) OVER (PARTITION BY market_id, model) AS w FROM long_scores"


@query(
    "s_each_market_once",
    with_views(f"SELECT model, n, {rounded(METRICS)} FROM {metric_sql('weighted', ['model'], w='w')}", "long_scores",
               extra={"weighted": WEIGHTED}),
)
def s_each_market_once(spark, d):
    weighted = M.market_weights(V.scored(spark, d))
    long = V.long_scores(weighted, ["market_id", "outcome", "weight"])
    return rnd(M.metric_table(long, ["model"], weight="weight"), *METRICS)


@query(
    "h_market_weights",
    with_views(
        f"""SELECT n_rows, count(*) AS markets, {r('max(w)', 6)} AS weight
            FROM (SELECT market_id, count(*) AS n_rows, (SELECT count(*)::DOUBLE / count(DISTINCT market_id) FROM scored) / count(*) AS w
                  FROM scored GROUP BY market_id) GROUP BY n_rows""", "scored"),
)
def h_market_weights(spark, d):
    w = M.market_weights(V.scored(spark, d).select("market_id"))
    per = w.groupBy("market_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("weight").alias("weight"))
    return rnd(per.groupBy("n_rows").agg(F.count(F.lit(1)).alias("markets"), F.max("weight").alias("weight")), "weight")


@query(
    "h_brier_skill",
    with_views(
        f"""SELECT m.model, {r('m.brier', 6)} AS brier, {r('(b.brier - m.brier) / b.brier', 6)} AS skill
            FROM {metric_sql('long_scores', ['model'])} m JOIN {metric_sql('long_scores', ['model'])} b ON b.model = 'market'""",
        "long_scores"),
)
def h_brier_skill(spark, d):
    return rnd(M.brier_skill(M.metric_table(long_scores(spark, d), ["model"]), [], "market"), "brier", "skill")


@query(
    "h_confusion",
    with_views(
        f"""SELECT model, tp, fp, fn, tn, {r('(tp + tn) / (tp + tn + fp + fn)', 6)} AS accuracy,
                   {r('coalesce(tp / nullif(tp + fp, 0), 0.0)', 6)} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0.0)', 6)} AS recall,
                   {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)', 6)} AS f1
            FROM (SELECT model, count(*) FILTER (p >= 0.5 AND outcome = 1) AS tp, count(*) FILTER (p >= 0.5 AND outcome = 0) AS fp,
                         count(*) FILTER (p < 0.5 AND outcome = 1) AS fn, count(*) FILTER (p < 0.5 AND outcome = 0) AS tn
                  FROM long_scores GROUP BY model)""", "long_scores"),
)
def h_confusion(spark, d):
    return rnd(M.confusion(long_scores(spark, d), ["model"]), "accuracy", "precision", "recall", "f1")


@query(
    "h_class_report",
    with_views(
        f"""SELECT model, class, {r('coalesce(hit / nullif(said, 0), 0.0)', 6)} AS precision,
                   {r('coalesce(hit / nullif(support, 0), 0.0)', 6)} AS recall,
                   {r('coalesce(2 * hit / nullif(said + support, 0), 0.0)', 6)} AS f1, support
            FROM (SELECT model, class, count(*) FILTER ((p >= 0.5) = (class = 1)) AS said, count(*) FILTER (outcome = class) AS support,
                         count(*) FILTER ((p >= 0.5) = (class = 1) AND outcome = class) AS hit
                  FROM long_scores, (SELECT unnest([0, 1]) AS class) GROUP BY model, class)""", "long_scores"),
)
def h_class_report(spark, d):
    return rnd(M.class_report(long_scores(spark, d), ["model"]), "precision", "recall", "f1")


F1_SQL = "2 * (tp / (tp + fp)) * (tp / tot_pos) / (tp / (tp + fp) + tp / tot_pos + 1e-9::DOUBLE)"


@query(
    "h_best_f1_threshold",
    with_views(
        f"""SELECT model, score AS threshold, {r('f1', 6)} AS f1 FROM (
              SELECT model, score, f1, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) AS rn
              FROM (SELECT *, {F1_SQL} AS f1 FROM {ranked_sql('long_scores', ['model'], clip=False)})) WHERE rn = 1""", "long_scores"),
)
def h_best_f1_threshold(spark, d):
    return rnd(M.best_f1_threshold(long_scores(spark, d), ["model"]), "f1")


@query(
    "h_best_grid_threshold",
    with_views(
        f"""SELECT model, step / 100.0::DOUBLE AS threshold, {r('f1', 6)} AS f1 FROM (
              SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, step) AS rn FROM (
                SELECT model, step, coalesce(2 * sum(outcome) FILTER (p >= step / 100.0::DOUBLE)
                         / (count(*) FILTER (p >= step / 100.0::DOUBLE) + sum(outcome)), 0.0) AS f1
                FROM long_scores, (SELECT unnest(range(10, 91)) AS step) GROUP BY model, step)) WHERE rn = 1""", "long_scores"),
)
def h_best_grid_threshold(spark, d):
    return rnd(M.best_grid_threshold(long_scores(spark, d), ["model"]), "f1")


@query(
    "h_curve_points",
    with_views(
        f"""SELECT model, score, {r('fp / tot_neg', 6)} AS fpr, {r('tp / tot_pos', 6)} AS tpr, {r('tp / (tp + fp)', 6)} AS precision
            FROM {ranked_sql('long_scores', ['model'], clip=False)}""", "long_scores"),
)
def h_curve_points(spark, d):
    return rnd(M.curve_points(long_scores(spark, d), ["model"]), "fpr", "tpr", "precision")


def bin_sql(op: str, n: int) -> str:
    return " + ".join(f"CASE WHEN p {op} {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in M.bin_edges(n)[1:-1])


def calibration_sql(op: str, n: int) -> str:
    return with_views(
        f"""SELECT model, CAST(bin AS INTEGER) AS bin, n, {r('mean_pred', 6)} AS mean_pred, {r('actual', 6)} AS actual,
                   CASE WHEN actual - mean_pred < -0.05 THEN 'over-confident' WHEN actual - mean_pred > 0.05 THEN 'under-confident' ELSE '' END AS flag
            FROM (SELECT model, {bin_sql(op, n)} AS bin, count(*) AS n, avg(p) AS mean_pred, avg(outcome) AS actual
                  FROM long_scores GROUP BY ALL)""", "long_scores")


@query("h_calibration_curve", calibration_sql(">", 20))
def h_calibration_curve(spark, d):
    return rnd(M.calibration_table(long_scores(spark, d), ["model"], 20), "mean_pred", "actual")


@query("h_calibration_bins", calibration_sql(">=", 10))
def h_calibration_bins(spark, d):
    return rnd(M.calibration_table(long_scores(spark, d), ["model"], 10, right_closed=False), "mean_pred", "actual")


@query(
    "h_calibration_error",
    with_views(
        f"""SELECT model, {r('sum(gap) / sum(n)', 6)} AS ece FROM (
              SELECT model, {bin_sql('>=', 10)} AS bin, count(*) AS n, abs(sum(p) - sum(outcome)) AS gap FROM long_scores GROUP BY ALL)
            GROUP BY model""", "long_scores"),
)
def h_calibration_error(spark, d):
    return rnd(M.expected_calibration_error(long_scores(spark, d), ["model"]), "ece")


AUC_BOOTS, LOSS_BOOTS, ROW_BOOTS = 500, 1000, 500


def auc_boot_sql(group: str, n_boot: int, source: str = "scored", w: str = "1", base: str = "price_at_snapshot", new: str = "p_model_a", extra=None, views=("scored",)) -> str:
    sums = f"""SELECT {group}, which, score, sum(w * outcome)::DOUBLE AS pos, sum(w * (1 - outcome))::DOUBLE AS neg FROM (
        SELECT {group}, {w} AS w, outcome, 'base' AS which, {base} AS score FROM {source} UNION ALL
        SELECT {group}, {w}, outcome, 'new', {new} FROM {source}) GROUP BY ALL"""
    resampled = f"""SELECT b, which, score, sum(pos) AS pos, sum(neg) AS neg
        FROM draws JOIN groups USING (idx) JOIN sums USING ({group}) GROUP BY ALL"""

    def aucs(source, key):
        return f"""SELECT {key} AS b, max(auc) FILTER (which = 'new') - max(auc) FILTER (which = 'base') AS diff FROM (
            SELECT {key}, which, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
              SELECT *, coalesce(sum(neg) OVER (PARTITION BY {key}, which ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
              FROM {source}) GROUP BY {key}, which) GROUP BY {key}"""

    whole = "SELECT 0 AS k, which, score, sum(pos) AS pos, sum(neg) AS neg FROM sums GROUP BY ALL"
    return with_views(
        f"""SELECT {r('quantile_cont(diff, 0.025)', 6)} AS ci_lo, {r('quantile_cont(diff, 0.975)', 6)} AS ci_hi,
                   avg(CASE WHEN diff <= 0 THEN 1 ELSE 0 END) AS p_value, count(*) AS replicates,
                   {r('(SELECT max(diff) FROM point)', 6)} AS point
            FROM reps WHERE diff IS NOT NULL""", *views,
        extra={**(extra or {}), "groups": groups_sql(source, group), "draws": draws_sql("groups", n_boot, 42), "sums": sums,
               "resampled": resampled, "whole": whole, "reps": aucs("resampled", "b"), "point": aucs("whole", "k")})


@query("h_bootstrap_auc", auc_boot_sql("market_id", AUC_BOOTS))
def h_bootstrap_auc(spark, d):
    out = BS.bootstrap_auc_diff(V.scored(spark, d), "price_at_snapshot", "p_model_a", "market_id", AUC_BOOTS)
    return rnd(out, "ci_lo", "ci_hi", "point")


@query("h_bootstrap_auc_rows", auc_boot_sql("row_key", ROW_BOOTS))
def h_bootstrap_auc_rows(spark, d):
    out = BS.bootstrap_auc_diff(V.scored(spark, d), "price_at_snapshot", "p_model_a", "row_key", ROW_BOOTS)
    return rnd(out, "ci_lo", "ci_hi", "point")


ONCE_SQL = "SELECT *, (SELECT count(*)::DOUBLE / count(DISTINCT market_id) FROM scored) / count(*) OVER (PARTITION BY market_id) AS w FROM scored"


@query("s_each_market_once_auc", auc_boot_sql("market_id", AUC_BOOTS, "once", "w", extra={"once": ONCE_SQL}))
def s_each_market_once_auc(spark, d):
    """Difference in AUC with every market counted once, with its interval."""
    weighted = M.market_weights(V.scored(spark, d))
    return rnd(BS.bootstrap_auc_diff(weighted, "price_at_snapshot", "p_model_a", "market_id", AUC_BOOTS, weight="weight"), "ci_lo", "ci_hi", "point")


def ratio_boot_sql(per_group: str, ratios: dict[str, tuple[str, str]], n_boot: int, *views: str, extra=None) -> str:
    cols = sorted({c for pair in ratios.values() for c in pair})
    sums = ", ".join(f"sum({c}) AS {c}" for c in cols)
    long = " UNION ALL ".join(f"SELECT '{n}' AS measure, {{key}} {a} / nullif({b}, 0) AS value FROM {{src}}" for n, (a, b) in ratios.items())
    return with_views(
        f"""SELECT measure, {r('quantile_cont(value, 0.025)', 6)} AS ci_lo, {r('quantile_cont(value, 0.975)', 6)} AS ci_hi,
                   avg(CASE WHEN value <= 0 THEN 1 ELSE 0 END) AS p_value, count(*) AS replicates,
                   {r('(SELECT value FROM point WHERE point.measure = reps.measure)', 6)} AS point
            FROM reps WHERE value IS NOT NULL GROUP BY measure""", *views,
        extra={**(extra or {}), "per_group": per_group, "groups": groups_sql("per_group", "market_id"),
               "draws": draws_sql("groups", n_boot, 42),
               "resampled": f"SELECT b, {sums} FROM draws JOIN groups USING (idx) JOIN per_group USING (market_id) GROUP BY b",
               "whole": f"SELECT {sums} FROM per_group",
               "reps": long.format(key="b,", src="resampled"), "point": long.format(key="", src="whole")})


def loss_sql(p: str) -> str:
    q = f"least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
    return f"-(outcome * ln({q}) + (1 - outcome) * ln(1 - {q}))"


LOSS_GROUPS = f"""SELECT market_id, sum({loss_sql('p_model_a')} - {loss_sql('price_at_snapshot')}) AS d_log_loss,
    sum((p_model_a - outcome) ** 2 - (price_at_snapshot - outcome) ** 2) AS d_brier, count(*)::DOUBLE AS weight_sum
    FROM scored GROUP BY market_id"""


@query("h_bootstrap_losses", ratio_boot_sql(
    LOSS_GROUPS, {"log_loss": ("d_log_loss", "weight_sum"), "brier": ("d_brier", "weight_sum")}, LOSS_BOOTS, "scored"))
def h_bootstrap_losses(spark, d):
    out = BS.bootstrap_loss_diff(V.scored(spark, d), "price_at_snapshot", "p_model_a", "market_id", LOSS_BOOTS)
    return rnd(out, "ci_lo", "ci_hi", "point")


ROLLUP_SQL = """SELECT model, market_id, min_by(outcome, (snapshot_timestamp, row_key)) AS outcome, avg(p) AS p_mean,
    max_by(p, (snapshot_timestamp, row_key)) AS p_last, stddev_samp(p) AS p_std, count(*) AS n_snapshots
    FROM long_scores GROUP BY model, market_id"""


@query("s_each_market_once_losses", ratio_boot_sql(
    f"""SELECT market_id, sum(w * ({loss_sql('p_model_a')} - {loss_sql('price_at_snapshot')})) AS d_log_loss,
        sum(w * ((p_model_a - outcome) ** 2 - (price_at_snapshot - outcome) ** 2)) AS d_brier, sum(w) AS weight_sum FROM once GROUP BY market_id""",
    {"log_loss": ("d_log_loss", "weight_sum"), "brier": ("d_brier", "weight_sum")}, LOSS_BOOTS, "scored", extra={"once": ONCE_SQL}))
def s_each_market_once_losses(spark, d):
    out = BS.bootstrap_loss_diff(M.market_weights(V.scored(spark, d)), "price_at_snapshot", "p_model_a", "market_id", LOSS_BOOTS, weight="weight")
    return rnd(out, "ci_lo", "ci_hi", "point")


def market_level(spark, d) -> DataFrame:
    return M.market_rollup(long_scores(spark, d, "snapshot_timestamp", "row_key"), ["model"], tie="row_key")


@query(
    "d_market_rollup",
    with_views(f"SELECT model, market_id, outcome, {r('p_mean', 6)} AS p_mean, p_last, {r('p_std', 6)} AS p_std, n_snapshots FROM ({ROLLUP_SQL})",
               "long_scores"),
)
def d_market_rollup(spark, d):
    return rnd(market_level(spark, d), "p_mean", "p_std")


@query(
    "h_market_level",
    with_views(
        f"""SELECT m.model, n, {rounded(METRICS)}, {r('accuracy', 6)} AS accuracy, {r('f1', 6)} AS f1
            FROM {metric_sql('rolled', ['model'], p='p_mean')} m
            JOIN (SELECT model, avg(CASE WHEN (p_mean >= 0.5) = (outcome = 1) THEN 1 ELSE 0 END) AS accuracy,
                         coalesce(2 * count(*) FILTER (p_mean >= 0.5 AND outcome = 1) / nullif(count(*) FILTER (p_mean >= 0.5) + sum(outcome), 0), 0.0) AS f1
                  FROM rolled GROUP BY model) c ON c.model = m.model""", "long_scores",
        extra={"rolled": f"SELECT model, market_id, outcome, {r('p_mean', 9)} AS p_mean FROM ({ROLLUP_SQL})"}),
)
def h_market_level(spark, d):
    rolled = market_level(spark, d).withColumn("p_mean", half_up("p_mean", 9))
    m = M.metric_table(rolled, ["model"], p="p_mean")
    c = M.confusion(rolled, ["model"], p="p_mean").select("model", "accuracy", "f1")
    return rnd(m.join(c, "model"), *METRICS, "accuracy", "f1")


@query(
    "h_volume_weighted_auc",
    with_views(
        f"""SELECT u.model, {r('u.auc', 6)} AS auc, {r('w.auc', 6)} AS auc_weighted
            FROM {auc_sql('rolled', ['model'], p='p_mean')} u JOIN {auc_sql('rolled', ['model'], p='p_mean', w='log_volume')} w ON u.model = w.model""",
        "long_scores",
        extra={"rolled": f"""SELECT model, market_id, min(outcome) AS outcome, {r('avg(p)', 9)} AS p_mean, {r('max(ln(1 + total_volume))', 4)} AS log_volume
                FROM long_scores GROUP BY ALL"""}),
)
def h_volume_weighted_auc(spark, d):
    rolled = long_scores(spark, d, "total_volume").groupBy("model", "market_id").agg(
        F.min("outcome").alias("outcome"), half_up(F.avg("p"), 9).alias("p_mean"),
        half_up(F.max(F.log1p("total_volume")), 4).alias("log_volume"))
    plain = M.auc(rolled, ["model"], "p_mean")
    weighted = M.auc(rolled, ["model"], "p_mean", weight="log_volume").withColumnRenamed("auc", "auc_weighted")
    return rnd(plain.join(weighted, "model"), "auc", "auc_weighted")


@query(
    "h_market_weighted_accuracy",
    with_views(
        f"""SELECT model, {r('avg(acc)', 6)} AS accuracy, {r('avg(brier)', 6)} AS brier, count(*) AS markets FROM (
              SELECT model, market_id, avg(CASE WHEN (p >= 0.5) = (outcome = 1) THEN 1 ELSE 0 END) AS acc, avg((p - outcome) ** 2) AS brier
              FROM long_scores GROUP BY ALL) GROUP BY model""", "long_scores"),
)
def h_market_weighted_accuracy(spark, d):
    per = long_scores(spark, d).groupBy("model", "market_id").agg(
        F.avg(((F.col("p") >= 0.5) == (F.col("outcome") == 1)).cast("int")).alias("acc"),
        F.avg((F.col("p") - F.col("outcome")) * (F.col("p") - F.col("outcome"))).alias("brier"))
    return rnd(per.groupBy("model").agg(
        F.avg("acc").alias("accuracy"), F.avg("brier").alias("brier"), F.count(F.lit(1)).alias("markets")), "accuracy", "brier")


@query(
    "h_model_table",
    with_views(
        f"""SELECT m.model, {', '.join(f'{r("m." + c, 6)} AS {c}' for c in METRICS)}, {', '.join(f'{r(f"m.{c} - b.{c}", 6)} AS delta_{c}' for c in METRICS)}
            FROM {metric_sql('long_scores', ['model'])} m JOIN {metric_sql('long_scores', ['model'])} b ON b.model = 'market'""", "long_scores"),
)
def h_model_table(spark, d):
    t = M.with_baseline(M.metric_table(long_scores(spark, d), ["model"]).drop("n"), [], "market", METRICS)
    return rnd(t, *METRICS, *[f"delta_{c}" for c in METRICS])


@query(
    "h_headline",
    with_views(
        f"""SELECT release, model AS headline, {r('auc', 6)} AS auc FROM (
              SELECT *, row_number() OVER (PARTITION BY release ORDER BY auc DESC, model) AS rn
              FROM {auc_sql('released', ['release', 'model'])}) WHERE rn = 1""", "long_scores",
        extra={"released": "SELECT *, 'r' || (1 + market_id % 3) AS release FROM long_scores"}),
)
def h_headline(spark, d):
    df = long_scores(spark, d).withColumn("release", F.concat(F.lit("r"), (1 + F.col("market_id") % 3).cast("string")))
    return rnd(M.headline_models(M.auc(df, ["release", "model"])), "auc")


# ---------------------------------------------------------------- slices

RANKED_SQL = """SELECT *, (row_number() OVER (PARTITION BY market_id ORDER BY snapshot_timestamp, row_key) - 1)::DOUBLE
    / count(*) OVER (PARTITION BY market_id) AS rank_pct FROM scored"""
LONG_FROM = """SELECT *, 'market' AS model, price_at_snapshot AS p FROM {t} UNION ALL
    SELECT *, 'model_a', p_model_a FROM {t} UNION ALL SELECT *, 'model_b', p_model_b FROM {t}"""


def rank_scored(spark, d) -> DataFrame:
    return S.rank_fraction(V.scored(spark, d), ["snapshot_timestamp", "row_key"])


@query("e_rank_fraction", with_views("SELECT row_key, rank_pct FROM ranked", "scored", extra={"ranked": RANKED_SQL}))
def e_rank_fraction(spark, d):
    return rank_scored(spark, d).select("row_key", "rank_pct")


@query(
    "s_lifecycle_rank",
    with_views(slice_sql("cut", ["model", "bucket"]), "scored", extra={
        "ranked": RANKED_SQL, "long": LONG_FROM.format(t="ranked"),
        "cut": f"SELECT *, {case_buckets('rank_pct', S.THIRDS)} AS bucket FROM long"}),
)
def s_lifecycle_rank(spark, d):
    df = V.long_scores(rank_scored(spark, d), ["market_id", "outcome", "rank_pct"])
    return rnd(S.auc_by(df.withColumn("bucket", S.half_open("rank_pct", S.THIRDS)), ["model", "bucket"]), "auc")


def cut_query(name: str, col: str, buckets, closed: bool = False):
    sql = with_views(slice_sql("cut", ["model", "bucket"]), "long_scores",
                     extra={"cut": f"SELECT *, {case_buckets(col, buckets, closed)} AS bucket FROM long_scores"})

    @query(name, sql)
    def run(spark, d):
        df = long_scores(spark, d, col)
        label = (S.closed if closed else S.half_open)(col, buckets)
        return rnd(S.auc_by(df.withColumn("bucket", label), ["model", "bucket"]), "auc")


cut_query("s_lifecycle_elapsed", "pct_lifetime_elapsed", S.THIRDS)
cut_query("s_time_left", "days_before_close", S.TIME_LEFT)


def days_left_query(name: str, buckets, min_rows: int):
    cases = " ".join(f"WHEN days_before_close > {lo} AND days_before_close <= {hi} THEN '{label}'" for label, lo, hi in buckets)
    sql = f"""SELECT * FROM ({slice_sql('cut', ['model', 'bucket'])}) WHERE n >= {min_rows} AND bucket IS NOT NULL"""

    @query(name, with_views(sql, "long_scores", extra={"cut": f"SELECT *, CASE {cases} END AS bucket FROM long_scores"}))
    def run(spark, d):
        df = long_scores(spark, d, "days_before_close").withColumn("bucket", S.left_open("days_before_close", buckets))
        return rnd(S.auc_by(df.filter("bucket IS NOT NULL"), ["model", "bucket"], min_rows), "auc")


days_left_query("s_time_left_stages", S.STAGES_LEFT, 1)
days_left_query("s_time_left_wide", S.DAYS_LEFT, 100)


@query(
    "s_time_left_by_duration",
    with_views(
        f"""SELECT a.duration, a.time_left, a.model, {r('a.auc', 6)} AS auc, {r('a.auc - b.auc', 6)} AS delta_auc
            FROM {auc_sql('cut', ['duration', 'time_left', 'model'])} a
            JOIN {auc_sql('cut', ['duration', 'time_left', 'model'])} b ON b.model = 'market' AND a.duration = b.duration AND a.time_left = b.time_left""",
        "long_scores",
        extra={"cut": f"SELECT *, {case_buckets('duration_days', S.DURATION_WIDE, True)} AS duration, {case_buckets('days_before_close', S.TIME_LEFT)} AS time_left FROM long_scores"}),
)
def s_time_left_by_duration(spark, d):
    df = long_scores(spark, d, "duration_days", "days_before_close")
    df = df.withColumn("duration", S.closed("duration_days", S.DURATION_WIDE)).withColumn(
        "time_left", S.half_open("days_before_close", S.TIME_LEFT))
    t = M.with_baseline(M.auc(df, ["duration", "time_left", "model"]), ["duration", "time_left"], "market", ["auc"])
    return rnd(t.select("duration", "time_left", "model", "auc", "delta_auc"), "auc", "delta_auc")


@query(
    "s_by_category",
    with_views(
        f"""SELECT m.model, m.category, m.n, {', '.join(f'{r("m." + c, 6)} AS {c}' for c in ("auc", "pr_auc"))}, {r('f.f1', 6)} AS f1, {r('f.yes_rate', 6)} AS yes_rate
            FROM {metric_sql('long_scores', ['model', 'category'])} m
            JOIN (SELECT model, category, avg(outcome) AS yes_rate,
                         coalesce(2 * count(*) FILTER (p >= 0.5 AND outcome = 1) / nullif(count(*) FILTER (p >= 0.5) + sum(outcome), 0), 0.0) AS f1
                  FROM long_scores GROUP BY ALL) f ON f.model = m.model AND f.category = m.category WHERE m.n >= 10""", "long_scores"),
)
def s_by_category(spark, d):
    df = long_scores(spark, d, "category")
    keys = ["model", "category"]
    m = M.metric_table(df, keys).filter("n >= 10").select(*keys, "n", "auc", "pr_auc")
    cells = M.confusion(df, keys)
    rate = (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"))
    return rnd(m.join(cells.select(*keys, "f1", rate.alias("yes_rate")), keys), "auc", "pr_auc", "f1", "yes_rate")


@query(
    "s_lifecycle_bins",
    with_views(slice_sql("cut", ["model", "bin"], 300), "long_scores",
               extra={"cut": "SELECT *, CAST(least(greatest(floor(pct_lifetime_elapsed / ((1.0::DOUBLE - 0.0) / 25)), 0), 24) AS BIGINT) AS bin FROM long_scores"}),
)
def s_lifecycle_bins(spark, d):
    df = long_scores(spark, d, "pct_lifetime_elapsed")
    binned = df.withColumn("bin", S.equal_width(F.col("pct_lifetime_elapsed"), F.lit(0.0), F.lit(1.0), 25))
    return rnd(S.auc_by(binned, ["model", "bin"], 300), "auc")


@query(
    "s_lifecycle_accuracy",
    with_views(
        f"""SELECT model, bin, count(*) AS n, {r('avg(CASE WHEN (p > 0.5) = (outcome = 1) THEN 1 ELSE 0 END)', 6)} AS accuracy
            FROM (SELECT *, CAST(least(greatest(floor(pct_lifetime_elapsed / ((1.0::DOUBLE - 0.0) / 5)), 0), 4) AS BIGINT) AS bin FROM long_scores)
            GROUP BY ALL HAVING count(*) >= 100""", "long_scores"),
)
def s_lifecycle_accuracy(spark, d):
    df = long_scores(spark, d, "pct_lifetime_elapsed")
    binned = df.withColumn("bin", S.equal_width(F.col("pct_lifetime_elapsed"), F.lit(0.0), F.lit(1.0), 5))
    right = ((F.col("p") > 0.5) == (F.col("outcome") == 1)).cast("int")
    out = binned.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"))
    return rnd(out.filter("n >= 100"), "accuracy")


QUANTILE_SQL = """SELECT s.*, CAST(greatest(len(list_filter(e.edges, lambda x: x < s.{col})), 1) AS INTEGER) AS bin
    FROM {src} s, (SELECT list_sort(list_distinct(list_value({edges}))) AS edges FROM {src}) e"""


def quantile_sql(src: str, col: str, n: int) -> str:
    edges = ", ".join(f"quantile_cont({col}, {k / n!r})" for k in range(n + 1))
    return QUANTILE_SQL.format(src=src, col=col, edges=edges)


MARKET_SQL = f"""SELECT model, market_id, min(outcome) AS outcome, {r('avg(p)', 9)} AS p, min(duration_days) AS duration_days,
    max(total_volume) AS total_volume FROM long_scores GROUP BY ALL"""


def market_means(spark, d) -> DataFrame:
    return long_scores(spark, d, "duration_days", "total_volume").groupBy("model", "market_id").agg(
        F.min("outcome").alias("outcome"), half_up(F.avg("p"), 9).alias("p"),
        F.min("duration_days").alias("duration_days"), F.max("total_volume").alias("total_volume"))


@query(
    "s_duration_quantiles",
    with_views(slice_sql("cut", ["model", "bin"], 15), "long_scores",
               extra={"rolled": MARKET_SQL, "cut": quantile_sql("rolled", "duration_days", 20)}),
)
def s_duration_quantiles(spark, d):
    return rnd(S.auc_by(S.quantile_bins(market_means(spark, d), "duration_days", 20), ["model", "bin"], 15), "auc")


@query(
    "e_quantile_bins",
    with_views("SELECT bin, count(*) AS n, min(total_volume) AS lo, max(total_volume) AS hi FROM cut GROUP BY bin", "scored",
               extra={"cut": quantile_sql("scored", "total_volume", 4)}),
)
def e_quantile_bins(spark, d):
    df = S.quantile_bins(V.scored(spark, d), "total_volume", 4)
    return df.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("total_volume").alias("lo"), F.max("total_volume").alias("hi"))


@query(
    "s_has_trend_data",
    with_views(slice_sql("t", ["has_trend_data"]), "clean", extra={"t": "SELECT *, price_at_snapshot AS p FROM clean"}),
)
def s_has_trend_data(spark, d):
    df = stored_clean(spark, d).withColumn("p", F.col("price_at_snapshot"))
    return rnd(S.auc_by(df, ["has_trend_data"]), "auc")


@query(
    "s_trend_lift",
    with_views(
        f"""SELECT a.category, {r('b.auc - a.auc', 6)} AS lift FROM {auc_sql('t', ['category'], p='p_a')} a
            JOIN {auc_sql('t', ['category'], p='p_b')} b ON a.category = b.category""", "clean",
        extra={"t": "SELECT *, price_at_snapshot AS p_a, least(greatest(price_at_snapshot + trend_spike * 0.1 - 0.0005 * trend_change_4w, 0.001), 0.999) AS p_b FROM clean WHERE category <> 'other'"}),
)
def s_trend_lift(spark, d):
    nudged = F.col("price_at_snapshot") + F.col("trend_spike") * 0.1 - 0.0005 * F.col("trend_change_4w")
    df = stored_clean(spark, d).filter(F.col("category") != "other").withColumn("p_b", F.least(F.greatest(nudged, F.lit(0.001)), F.lit(0.999)))
    plain, lifted = M.auc(df, ["category"], "price_at_snapshot"), M.auc(df, ["category"], "p_b")
    joined = plain.join(lifted.withColumnRenamed("auc", "auc_b"), "category")
    return joined.select("category", half_up(F.col("auc_b") - F.col("auc"), 6).alias("lift"))


@query(
    "s_train_baseline",
    with_views(
        f"""SELECT n, {r('auc', 6)} AS auc, {r('log_loss', 6)} AS log_loss,
                   {r("(SELECT avg(CASE WHEN (price_at_snapshot > 0.5) = (outcome = 1) THEN 1 ELSE 0 END) FROM clean WHERE split = 'train')", 6)} AS accuracy
            FROM {metric_sql('t', [])}""", "clean", extra={"t": "SELECT *, price_at_snapshot AS p FROM clean WHERE split = 'train'"}),
)
def s_train_baseline(spark, d):
    train = stored_clean(spark, d).filter(F.col("split") == "train")
    m = M.metric_table(train, [], "price_at_snapshot").select("n", "auc", "log_loss")
    right = ((F.col("price_at_snapshot") > 0.5) == (F.col("outcome") == 1)).cast("int")
    return rnd(m.withColumn("accuracy", train.agg(F.avg(right).alias("a")).scalar()), "auc", "log_loss", "accuracy")


PCT_TARGETS = [0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9]
SEVEN_SQL = """SELECT market_id, target, row_key, outcome, category, p_model_a, pct_lifetime_elapsed FROM (
    SELECT s.*, t.target, row_number() OVER (PARTITION BY market_id, target ORDER BY abs(pct_lifetime_elapsed - target), pct_lifetime_elapsed, row_key) AS rn
    FROM scored s, (SELECT unnest([{t}])::DOUBLE AS target) t) WHERE rn = 1""".format(t=", ".join(map(str, PCT_TARGETS)))


def seven_points(spark, d) -> DataFrame:
    df = V.scored(spark, d)
    return B.nearest_rows(df, PCT_TARGETS, F.col("pct_lifetime_elapsed"), ["pct_lifetime_elapsed", "row_key"],
                          ["pct_lifetime_elapsed", "row_key", "outcome", "category", "p_model_a"], name="target").drop("position", "distance")


@query("e_lifetime_percentiles", with_views("SELECT * FROM seven", "scored", extra={"seven": SEVEN_SQL}))
def e_lifetime_percentiles(spark, d):
    return seven_points(spark, d)


@query(
    "s_percentile_category",
    with_views(
        f"""SELECT target, category, n, {r('auc', 6)} AS auc, {r('brier', 6)} AS brier FROM {metric_sql('seven', ['target', 'category'], p='p_model_a')}""",
        "scored", extra={"seven": SEVEN_SQL}),
)
def s_percentile_category(spark, d):
    m = M.metric_table(seven_points(spark, d), ["target", "category"], "p_model_a")
    return rnd(m.select("target", "category", "n", "auc", "brier"), "auc", "brier")


@query(
    "s_error_by_percentile",
    with_views(
        f"""SELECT target, {r('avg(abs(p_model_a - outcome))', 6)} AS mae, {r('quantile_cont(p_model_a - outcome, 0.25)', 6)} AS q25,
                   {r('quantile_cont(p_model_a - outcome, 0.5)', 6)} AS q50, {r('quantile_cont(p_model_a - outcome, 0.75)', 6)} AS q75
            FROM seven GROUP BY target""", "scored", extra={"seven": SEVEN_SQL}),
)
def s_error_by_percentile(spark, d):
    df = seven_points(spark, d).withColumn("err", F.col("p_model_a") - F.col("outcome"))
    mae = df.groupBy("target").agg(F.avg(F.abs("err")).alias("mae"))
    q = exact_percentiles(df, ["target"], "err", [0.25, 0.5, 0.75])
    wide = q.groupBy("target").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                     for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    return rnd(mae.join(wide, "target"), "mae", "q25", "q50", "q75")


@query(
    "d_percentile_points",
    with_views(
        f"""SELECT target, {r('avg(pct_lifetime_elapsed)', 6)} AS mean_actual, count(*) AS n,
                   (SELECT min(c) = 7 AND max(c) = 7 FROM (SELECT count(*) AS c FROM seven GROUP BY market_id)) AS all_seven
            FROM seven GROUP BY target""", "scored", extra={"seven": SEVEN_SQL}),
)
def d_percentile_points(spark, d):
    df = seven_points(spark, d)
    sizes = df.groupBy("market_id").agg(F.count(F.lit(1)).alias("c")).agg(((F.min("c") == 7) & (F.max("c") == 7)).alias("ok"))
    out = df.groupBy("target").agg(F.avg("pct_lifetime_elapsed").alias("mean_actual"), F.count(F.lit(1)).alias("n"))
    return rnd(out, "mean_actual").withColumn("all_seven", sizes.scalar())
