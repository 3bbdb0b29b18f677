"""The forest splits on categories as sets, whatever the order of their codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.operators import modeling as ML


def test_forest_parts_categories_in_sets_and_takes_unknown_ones(spark):
    names = [f"c{i:02d}" for i in range(40)]
    rows = [(c, float(k % 7), i % 2, 1.0) for i, c in enumerate(names) for k in range(20)]
    train = spark.createDataFrame(rows, "category string, price_at_snapshot double, outcome int, weight double").coalesce(1)
    model = ML.fit_forest(["price_at_snapshot"], 20)(train, {"max_depth": 2, "min_samples_leaf": 1})
    asked = spark.createDataFrame([(c, 3.0) for c in names] + [("new", 3.0)], "category string, price_at_snapshot double")
    scored = model.transform(asked).select("category", F.element_at(ML.vector_to_array("probability"), 2).alias("p")).collect()
    p = {r.category: r.p for r in scored}
    assert min(p[c] for c in names[1::2]) > max(p[c] for c in names[::2]) and 0 <= p["new"] <= 1
    shares = {r.feature: r.importance for r in ML.importance_table(model, train, ["price_at_snapshot"]).collect()}
    assert set(shares) == {"price_at_snapshot", "category"} and shares["category"] > 0.9
