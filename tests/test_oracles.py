"""Registered queries against their SQL text on the smallest tables. TALLYCAST_ALL=1 runs every query."""

from __future__ import annotations

import os

import check_queries
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["clean_dataset", "h_metrics", "s_lifecycle_rank", "h_bootstrap_auc", "t_tau_cost_sweep", "t_one_per_market",
         "a_catalogue_parse", "b_market_filter", "q_meta_checks", "q_track_status", "d_describe", "c_asof_prices"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TALLYCAST_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    problem, n = check_queries.compare(entry.queries()[name](spark, SF), check_queries.connect(SF), entry.oracle_sql()[name])
    assert not problem


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
