"""Queries on scored rows shuffle the lines once."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tallycast.operators import slices
from tallycast.sources import tables as TB

SF = "/root/testdata/sf0.01"


def plan_of(spark, df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plain(spark):
    """Joins by shuffle and plans as they stand, as on large tables."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["c_wide_models", "c_same_rows", "e_rank_fraction"])
def test_scored_rows_are_shuffled_once(plain, name):
    assert plan_of(plain, entry.queries()[name](plain, SF)).count("Exchange hashpartitioning(l_orderkey") == 1
    # customers, orders by customer, orders by order, lines
    assert plan_of(plain, entry.queries()[name](plain, SF)).count("Exchange ") == 4


def test_lifecycle_ranks_deal_lines_by_market_only(plain):
    plan = plan_of(plain, entry.queries()["s_lifecycle_rank"](plain, SF))
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(market_id" not in plan and "row_key" not in "".join(x for x in plan.splitlines() if "__place" in x)


def test_rank_fraction_of_ties_and_null_markets(spark):
    rows = [(None, 2, "b"), (None, 1, "c"), (1, 1, "b"), (1, 1, "a"), (1, None, "z"), (1, 5, "a"), (2, 1, "a")]
    out = slices.rank_fraction(spark.createDataFrame(rows, "market_id int, t int, k string"), ["t", "k"]).collect()
    assert {(r.market_id, r.t, r.k): r.rank_pct for r in out} == {
        (None, 1, "c"): 0.0, (None, 2, "b"): 0.5, (1, None, "z"): 0.0, (1, 1, "a"): 0.25, (1, 1, "b"): 0.5, (1, 5, "a"): 0.75, (2, 1, "a"): 0.0}


def test_distinct_keys_count_nulls_and_repeats(plain, monkeypatch):
    monkeypatch.setattr(TB, "KEY_ROWS", 2)
    rows = [("v", "a", "x"), ("v", "a", "x"), ("v", "a", None), ("v", "b", None), ("w", "a", "x"), (None, "a", "y")]
    dealt = TB.distinct_keys(plain.createDataFrame(rows, "v string, m string, k string"), ["v", "m"], "k", len(rows))
    assert sorted((r.v or "", r.m, r.n, r["keys"]) for r in dealt.collect()) == [("", "a", 1, 1), ("v", "a", 3, 1), ("v", "b", 1, 0), ("w", "a", 1, 1)]
    assert plan_of(plain, dealt).count("Exchange hashpartitioning(k") == 1 and plan_of(plain, dealt).count("Exchange hashpartitioning") == 2
