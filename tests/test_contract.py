"""Registered queries: names, checks on the smallest tables, and the shape of their plans."""

import os
import re
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

SOME = ["cross_history_20_50", "cross_current", "feature_panel_predict", "forward_labels", "sma_gap_filled", "average_report",
        "asof_join", "alert_feed", "refresh_candidates", "insert_if_absent", "snapshot_projection", "walk_forward_folds"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "ma_short" in df.columns


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, sf, name):
    text, _, ok = compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_no_query_pairs_all_rows(spark, sf):
    for name, fn in entry.queries().items():
        if name.startswith(("signals_b", "signals_t", "walk", "cv_", "feature_imp")):
            continue
        plan = fn(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Join Cross|Join Inner\s*$", plan, re.M), name
