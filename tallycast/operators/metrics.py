"""Ranking and calibration metrics for probability scores.

Equal scores are summed first (`score_table`), which makes tie handling exact and shrinks the data;
ranks come from running sums over coarse score levels, so no sort covers a whole table or slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles
from tallycast.functions.running import join_null_safe, running_sums
from tallycast.functions.timing import days

CLIP = 1e-6
SCORE_LEVELS = 65536
F1_GUARD = 1e-9


def clipped(p: Column | str, eps: float = CLIP) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def log_loss_of(p: Column | str, y: Column | str, eps: float = CLIP) -> Column:
    q = clipped(p, eps)
    y = F.col(y) if isinstance(y, str) else y
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def score_table(
    df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome", weight: str | None = None, eps: float | None = CLIP
) -> DataFrame:
    """(keys, score, pos, neg): weight of positive and negative rows per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    score = clipped(p, eps) if eps else F.col(p)
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*keys, score.alias("score")).agg(
        F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg")
    )


def ranked_scores(table: DataFrame, keys: list[str]) -> DataFrame:
    """The score table with `tp`/`fp` (weight at or above the score) and group totals."""
    t = table.withColumn("lvl", F.floor(F.col("score") * SCORE_LEVELS))
    run = running_sums(
        t, keys, ["lvl"], ["score"], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, totals=True
    )
    return run.select(
        *keys, "score", "pos", "neg",
        F.col("tot_cum_pos").alias("tot_pos"), F.col("tot_cum_neg").alias("tot_neg"),
        (F.col("cum_neg") - F.col("neg")).alias("neg_below"),
        (F.col("tot_cum_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("tot_cum_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
    )


def auc_of_ranked() -> Column:
    """Chance that a positive outranks a negative, ties counted half; NULL with one class."""
    return F.try_divide(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
        (F.max("tot_pos") * F.max("tot_neg")).cast("double"),
    )


def average_precision_of_ranked() -> Column:
    """Step-wise area under precision and recall."""
    step = F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return F.when(F.max("tot_neg") > 0, F.try_divide(F.sum(step), F.max("tot_pos").cast("double")))


def f1_of_ranked() -> Column:
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp"), F.col("tot_pos"))
    return 2 * precision * recall / (precision + recall + F1_GUARD)


def auc(df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome", weight: str | None = None) -> DataFrame:
    ranked = ranked_scores(score_table(df, keys, p, y, weight), keys)
    return ranked.groupBy(*keys).agg(auc_of_ranked().alias("auc"))


def metric_table(
    df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome", weight: str | None = None
) -> DataFrame:
    """AUC, average precision, log-loss, Brier score and row count per key.

    Everything is a function of the score table, so the input is read and shuffled once.
    """
    w = F.col(weight) if weight else F.lit(1)
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    table = rows.groupBy(*keys, clipped(p).alias("score")).agg(
        F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg"), F.count(F.lit(1)).alias("rows")
    )
    t = table.withColumn("lvl", F.floor(F.col("score") * SCORE_LEVELS))
    run = running_sums(t, keys, ["lvl"], ["score"], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, totals=True)
    s, total = F.col("score"), (F.max("tot_pos") + F.max("tot_neg")).cast("double")
    ranked = run.select(
        *keys, "score", "pos", "neg", "rows",
        F.col("tot_cum_pos").alias("tot_pos"), F.col("tot_cum_neg").alias("tot_neg"),
        (F.col("cum_neg") - F.col("neg")).alias("neg_below"),
        (F.col("tot_cum_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("tot_cum_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
    )
    loss = -(F.col("pos") * F.ln(s) + F.col("neg") * F.ln(1 - s))
    brier = F.col("pos") * (1 - s) * (1 - s) + F.col("neg") * s * s
    return ranked.groupBy(*keys).agg(
        F.sum("rows").alias("n"),
        auc_of_ranked().alias("auc"),
        average_precision_of_ranked().alias("pr_auc"),
        F.try_divide(F.sum(loss), total).alias("log_loss"),
        F.try_divide(F.sum(brier), total).alias("brier"),
    )


def confusion(df: DataFrame, keys: list[str], threshold: Column | float = 0.5, p: str = "p", y: str = "outcome") -> DataFrame:
    """Counts and rates at a threshold; a rate with an empty denominator is 0, as reports show it."""
    hit = F.col(p) >= threshold
    yes = F.col(y) == 1
    cells = df.groupBy(*keys).agg(
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"),
        F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def rate(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return cells.select(
        *keys, "tp", "fp", "fn", "tn",
        rate(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        rate(tp, tp + fp).alias("precision"),
        rate(tp, tp + fn).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def class_report(df: DataFrame, keys: list[str], threshold: float = 0.5, p: str = "p", y: str = "outcome") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    both = F.array(
        F.struct(F.lit(1).alias("class"), (F.col(p) >= threshold).alias("said"), (F.col(y) == 1).alias("is")),
        F.struct(F.lit(0).alias("class"), (F.col(p) < threshold).alias("said"), (F.col(y) == 0).alias("is")),
    )
    cells = df.select(*keys, F.inline(both)).groupBy(*keys, "class").agg(
        F.count_if(F.col("said") & F.col("is")).alias("tp"), F.count_if("said").alias("said"), F.count_if("is").alias("support")
    )
    tp, said, support = F.col("tp"), F.col("said"), F.col("support")
    return cells.select(
        *keys, "class",
        F.coalesce(F.try_divide(tp, said), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, support), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, said + support), F.lit(0.0)).alias("f1"),
        "support",
    )


def best_f1_threshold(df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome") -> DataFrame:
    """Score with the highest F1 when used as a threshold; the lowest such score on equal F1."""
    ranked = ranked_scores(score_table(df, keys, p, y, eps=None), keys).withColumn("f1", f1_of_ranked())
    best = F.max(F.struct("f1", (-F.col("score")).alias("neg_score")))
    return ranked.groupBy(*keys).agg(best.alias("best")).select(
        *keys, (-F.col("best.neg_score")).alias("threshold"), F.col("best.f1").alias("f1")
    )


def best_grid_threshold(df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome") -> DataFrame:
    """Best F1 over the thresholds 0.10, 0.11, ... 0.90; the first one on equal F1. Scores are summed per step
    first, so each key has at most 82 rows when they are ordered."""
    edges = [k / 100.0 for k in range(10, 91)]
    step = F.lit(9) + sum((F.when(F.col("score") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    cells = score_table(df, keys, p, y, eps=None).groupBy(*keys, step.alias("step")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = cells.groupBy(*keys).agg(F.collect_list(F.struct("step", "pos", "neg")).alias("cells"), F.sum("pos").alias("tot_pos"))
    steps = every.select(*keys, "tot_pos", "cells", F.explode(F.sequence(F.lit(10), F.lit(90))).alias("step"))
    above = lambda c: F.aggregate(F.filter("cells", lambda x: x.step >= F.col("step")), F.lit(0.0), lambda acc, x: acc + x[c])
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("tot_pos")), F.lit(0.0))
    tried = steps.withColumn("tp", above("pos")).withColumn("fp", above("neg"))
    best = tried.groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), (-F.col("step")).alias("neg_step"))).alias("best"))
    return best.select(*keys, (-F.col("best.neg_step") / 100.0).alias("threshold"), F.col("best.f1").alias("f1"))


def curve_points(df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome") -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    ranked = ranked_scores(score_table(df, keys, p, y, eps=None), keys)
    return ranked.select(
        *keys, "score",
        F.try_divide(F.col("fp"), F.col("tot_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("tot_pos")).alias("tpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def bin_edges(n_bins: int) -> list[float]:
    return [k * (1.0 / n_bins) for k in range(n_bins)] + [1.0]


def left_closed_bin(p: Column, n_bins: int = 10) -> Column:
    """Index of [edge, next edge); the last bin includes 1. Compared with the edges themselves, because
    an edge such as 3 * 0.1 lies just above 0.3."""
    inner = bin_edges(n_bins)[1:-1]
    return sum((F.when(p >= e, 1).otherwise(0) for e in inner), F.lit(0))


def right_closed_bin(p: Column, n_bins: int = 10) -> Column:
    """Index of (edge, next edge]; the first bin includes 0."""
    inner = bin_edges(n_bins)[1:-1]
    return sum((F.when(p > e, 1).otherwise(0) for e in inner), F.lit(0))


def calibration_table(
    df: DataFrame, keys: list[str], n_bins: int = 10, right_closed: bool = True, p: str = "p", y: str = "outcome"
) -> DataFrame:
    """Count, mean prediction and actual rate per non-empty bin, with a flag beyond 0.05."""
    binned = (right_closed_bin if right_closed else left_closed_bin)(F.col(p), n_bins)
    out = df.groupBy(*keys, binned.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("actual")
    )
    gap = F.col("actual") - F.col("mean_pred")
    return out.withColumn(
        "flag", F.when(gap < -0.05, "over-confident").when(gap > 0.05, "under-confident").otherwise("")
    )


def expected_calibration_error(
    df: DataFrame, keys: list[str], n_bins: int = 10, p: str = "p", y: str = "outcome"
) -> DataFrame:
    bins = df.groupBy(*keys, left_closed_bin(F.col(p), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.sum(p) - F.sum(y)).alias("gap")
    )
    return bins.groupBy(*keys).agg((F.sum("gap") / F.sum("n")).alias("ece"))


def market_weights(df: DataFrame, market: str = "market_id", name: str = "weight") -> DataFrame:
    """Adds 1 / (rows of the market), scaled to mean 1 over the table. The mean of 1/n over rows is
    markets / rows, so the scale needs only two counts."""
    sizes = df.groupBy(market).agg(F.count(F.lit(1)).alias("rows_of_market"))
    scale = sizes.agg((F.sum("rows_of_market") / F.count(F.lit(1))).alias("scale"))
    return (
        join_null_safe(df, sizes, [market])
        .withColumn(name, scale.scalar() / F.col("rows_of_market"))
        .drop("rows_of_market")
    )


def market_rollup(df: DataFrame, keys: list[str], p: str = "p", y: str = "outcome", ts: str = "snapshot_timestamp",
                  tie: str | None = None) -> DataFrame:
    """Per market: label, mean, last and sample deviation of the probability, number of snapshots."""
    when = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(*keys, "market_id").agg(
        F.min_by(y, when).alias(y), F.avg(p).alias("p_mean"), F.max_by(p, when).alias("p_last"),
        F.stddev_samp(p).alias("p_std"), F.count(F.lit(1)).alias("n_snapshots"),
    )


def with_baseline(metrics: DataFrame, keys: list[str], baseline: str, cols: list[str]) -> DataFrame:
    """Adds `delta_<col>` against the row of model `baseline` with the same keys."""
    base = metrics.filter(F.col("model") == baseline).select(*keys, F.struct(*cols).alias("base"))
    joined = join_null_safe(metrics, base, keys, "left") if keys else metrics.withColumn("base", base.select("base").scalar())
    return joined.withColumns({f"delta_{c}": F.col(c) - F.col(f"base.{c}") for c in cols}).drop("base")


def brier_skill(metrics: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    d = with_baseline(metrics.select(*keys, "model", "brier"), keys, baseline, ["brier"])
    base = F.col("brier") - F.col("delta_brier")
    return d.select(*keys, "model", "brier", F.try_divide(-F.col("delta_brier"), base).alias("skill"))


def headline_models(metrics: DataFrame) -> DataFrame:
    """Per release the model with the highest AUC (lowest name on equal AUC)."""
    best = F.min_by("model", F.struct((-F.col("auc")).alias("a"), "model"))
    return metrics.groupBy("release").agg(best.alias("headline"), F.max("auc").alias("auc"))
