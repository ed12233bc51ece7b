"""The plans: what reaches the scan, what is shuffled, and what must not appear."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from conftest import ROOT, plan_of

from tablewright.operators import explore, features, reshape, rows
from tablewright.plans.queries import FILTER, QUERIES

LAZY = [
    "filter_multi", "filter_patterns", "filter_dates", "filter_chain", "sort_desc", "split_column", "merge_columns",
    "replace_values", "map_columns", "hash_split", "frequency", "correlation", "correlation_matrix", "assemble_array",
    "polynomial", "standard_scale", "vector_index", "pca", "one_hot", "chi_square", "string_index",
    "string_index_join", "binary_metrics_hard", "multiclass_metrics", "flow_demo", "split_rows_delimiter",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, tiny, name):
    plan = plan_of(QUERIES[name](spark, tiny))
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(items):
    kept = rows.filter_rows(items, FILTER).select("l_orderkey")
    plan = plan_of(kept)
    assert "GreaterThan(l_quantity,30.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    read = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert [c.split(":")[0] for c in read.split(",")] == ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


def test_dates_reach_the_scan(orders):
    plan = plan_of(rows.filter_rows(orders, [{"colName": "o_orderdate", "operate": ">=", "value": "1997-06-01"}]))
    assert "GreaterThanOrEqual(o_orderdate,1997-06-01T00:00)" in plan


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: rows.filter_rows(df, FILTER),
        lambda df: reshape.merge_columns(df, ["l_returnflag", "l_linestatus"]),
        lambda df: reshape.split_rows(df, "l_returnflag", "p", "-"),
        lambda df: features.polynomial(df, ["l_tax", "l_discount"], "v"),
        lambda df: features.standard_scale(df, ["l_tax"], "v"),
        lambda df: features.string_index(df, "l_returnflag", "v"),
        lambda df: rows.hash_split(df, "l_orderkey", 0.7, 0.3)[0],
    ],
)
def test_row_operators_do_not_shuffle(items, operator):
    assert "Exchange" not in plan_of(operator(items))


def test_reports_shuffle_partial_results_once(items):
    for report in (explore.frequency(items, "l_returnflag"), explore.correlation(items, ["l_tax", "l_discount"])):
        assert "partial_" in plan_of(report)


def test_a_limit_on_a_sorted_table_is_a_top_k(orders):
    assert "TakeOrderedAndProject" in plan_of(rows.sort_rows(orders, "o_totalprice", "降序").limit(5))


def test_sources_keep_to_the_rules():
    for path in Path(ROOT, "tablewright").rglob("*.py"):
        if "llm" in path.parts:  # has its own rules in tests/llm
            continue
        text = path.read_text(encoding="utf-8")
        for word in ("localCheckpoint", "toPandas", "crossJoin", ".rdd", "applyInPandas", "pandas_udf"):
            assert word not in text, f"{word} in {path.name}"
