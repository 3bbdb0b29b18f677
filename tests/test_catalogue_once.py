"""Catalogue records are read once a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from tallycast.sources import catalogue as C

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["b_eligible", "b_qualifying_markets"])
def test_records_are_read_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("from_json(StructField(conditionId") for line in plan.splitlines()) <= 1
    assert sum("Filter" in line and "from_json" in line for line in plan.splitlines()) == 0


def test_fields_made_once_keep_names_and_nulls(spark):
    df = spark.createDataFrame([(1, '{"a": 2}'), (2, None), (3, "broken")], "k int, s string")
    kind = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    out = C.once(df, F.from_json("s", kind))
    assert out.columns == ["a", "b"] and [tuple(r) for r in out.collect()] == [(2, None), (None, None), (None, None)]
