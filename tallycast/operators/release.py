"""Comparison of a candidate release with production."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import exact_percentiles, half_up

MOVE = 0.05
MAX_ECE_INCREASE = 0.01
MIN_SHIFT = 0.0005


def promotion_checks(diffs: DataFrame) -> DataFrame:
    """Per model (auc_lo, auc_hi, loss_lo, loss_hi, ece_old, ece_new, edge_lo): failures, warnings, verdict."""
    fails = F.array_compact(F.array(
        F.when(F.col("auc_hi") < 0, "auc_regression"),
        F.when(F.col("loss_lo") > 0, "log_loss_regression"),
        F.when(F.col("ece_new") - F.col("ece_old") > MAX_ECE_INCREASE, "calibration"),
    ))
    warns = F.array_compact(F.array(F.when(F.col("edge_lo") <= 0, "no_edge_over_market")))
    return diffs.select("*", fails.alias("fails"), warns.alias("warnings")).withColumn("passed", F.size("fails") == 0)


def behaviour(df: DataFrame, old: str, new: str, old_threshold: float, new_threshold: float) -> DataFrame:
    """How far probabilities move: mean, 95th percentile, share beyond 0.05, label flips."""
    rows = df.select(F.abs(F.col(new) - F.col(old)).alias("move"),
                     ((F.col(old) >= old_threshold) != (F.col(new) >= new_threshold)).cast("int").alias("flip"))
    p95 = exact_percentiles(rows, [], "move", [0.95]).select("value").scalar()
    return rows.agg(
        F.avg("move").alias("mean_move"), F.avg((F.col("move") > MOVE).cast("int")).alias("share_moved"), F.avg("flip").alias("flip_rate"),
    ).withColumn("p95_move", p95)


def importance_shifts(old: DataFrame, new: DataFrame, top: int = 5) -> DataFrame:
    """Largest changes of (feature, importance), at most `top`, from 0.0005 up."""
    a, b = old.select("feature", F.col("importance").alias("old")), new.select("feature", F.col("importance").alias("new"))
    j = a.join(b, "feature", "full_outer").fillna(0.0, ["old", "new"])
    shift = half_up(F.abs(F.col("new") - F.col("old")), 6)
    return j.withColumn("shift", shift).filter(F.col("shift") >= MIN_SHIFT).orderBy(F.desc("shift"), F.desc("feature")).limit(top)


def settings_and_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Features added and removed per model (arrays), from (model, features) rows."""
    a, b = old.select("model", F.col("features").alias("old")), new.select("model", F.col("features").alias("new"))
    empty = F.array().cast("array<string>")
    o, n = F.coalesce("old", empty), F.coalesce("new", empty)
    return b.join(a, "model", "left").select(
        "model", F.sort_array(F.array_except(n, o)).alias("added"), F.sort_array(F.array_except(o, n)).alias("removed"))


def attribution(scores: DataFrame) -> DataFrame:
    """The three-step attribution per model from rows (model, step, auc, market_auc, log_loss): old model on old
    rows, old model on new rows, new model on new rows."""
    return scores.withColumn("edge", F.col("auc") - F.col("market_auc"))
