"""Registered queries: every SQL belongs to one, and a spread of them agree at sf0.001."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "average_by_status", "distribution_of_rows", "cross_table", "price_histogram",
    "outlier_rows", "filter_tree_counts", "comparison_summary", "slope_over_rows",
    "temporal_patterns_by_day", "entities", "fact_search", "budgeted_context",
    "answered_questions", "usage_by_scorecard", "streamed_window_counts",
]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHECKED) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck(FOLDER).execute(entry.oracle_sql()[name])
    rows = [tuple(r) for r in df.collect()]
    assert compare(df.columns, rows, [d[0] for d in cursor.description],
                   cursor.fetchall()) in ("exact", "near")
