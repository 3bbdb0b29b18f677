"""Models in a session that cannot be serialized, as one with job tags is."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallycast.operators import modeling as ML


@pytest.mark.parametrize("fitter, params", [
    (ML.fit_logistic, {"C": 1.0, "l1": False}), (lambda numeric: ML.fit_forest(numeric, 3), {"max_depth": 2, "min_samples_leaf": 1})])
def test_models_score_in_a_session_with_job_tags(spark, fitter, params):
    tagged = spark.newSession()
    tagged.addTag("a")
    rows = tagged.range(200).select(
        (F.col("id") % 2).cast("int").alias("outcome"), (F.col("id") % 2 + F.col("id") / 400.0).alias("x"), F.lit("c").alias("category"), F.lit(1.0).alias("weight"))
    try:
        found = ML.scored(fitter(["x"])(rows, params), rows).groupBy("outcome").agg(F.avg("p_raw").alias("p")).collect()
    finally:
        tagged.removeTag("a")
    p = {r.outcome: r.p for r in found}
    assert p[1] > 0.6 > 0.4 > p[0]
