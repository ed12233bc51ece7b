"""Filter, sort, split and sample on hand-made frames."""

from __future__ import annotations

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tablewright.functions.columns import parse_number
from tablewright.functions.fixed_values import DESCENDING
from tablewright.operators import rows
from tablewright.plans.queries import condition


def values(df, column):
    return [row[column] for row in df.collect()]


def test_and_binds_tighter_than_or(spark):
    df = spark.createDataFrame([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "a int, b int, c int")
    kept = rows.filter_rows(df, [condition("a", "=", "1", "OR"), condition("b", "=", "1", "and"), condition("c", "=", "1")])
    assert kept.count() == df.where("a = 1 OR b = 1 AND c = 1").count() == 5


def test_null_comparisons_drop_rows(gaps):
    assert rows.filter_rows(gaps, [condition("i", "!=", "1")]).count() == 1
    assert rows.filter_rows(gaps, [condition("s", "<>", "x")]).count() == 2


def test_numbers_in_text_compare_as_numbers(spark):
    df = spark.createDataFrame([("105.5",), ("abc",), ("9",), (None,)], "t string")
    assert values(rows.filter_rows(df, [condition("t", ">", "105")]), "t") == ["105.5"]


def test_text_against_a_number_column_keeps_nothing(gaps):
    assert rows.filter_rows(gaps, [condition("i", "=", "abc")]).count() == 0
    assert rows.filter_rows(gaps, [condition("i", "!=", "abc")]).count() == 0


def test_values_are_never_parsed_as_sql(spark):
    df = spark.createDataFrame([('a" OR "1" = "1',), ("b",)], "t string")
    assert rows.filter_rows(df, [condition("t", "==", 'a" OR "1" = "1')]).count() == 1


def test_date_and_boolean_columns(spark):
    df = spark.sql("SELECT DATE'2020-01-02' AS d, true AS b UNION ALL SELECT DATE'2021-01-02', false")
    assert rows.filter_rows(df, [condition("d", ">", "2020-06-01")]).count() == 1
    assert rows.filter_rows(df, [condition("b", "=", "true")]).count() == 1
    assert rows.filter_rows(df, [condition("d", ">", "no date")]).count() == 0


@pytest.mark.parametrize(
    "conditions",
    [
        [],
        [condition("i", ">", "1", "AND")],
        [condition("i", ">", "1"), condition("i", ">", "1")],
        [condition("i", "; DROP", "1")],
        [condition("nope", "=", "1")],
    ],
)
def test_bad_filters_raise(gaps, conditions):
    with pytest.raises(ValueError):
        rows.filter_rows(gaps, conditions)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["省/市 (State)", "a.b", "x y", "tick`s"])
    for name in df.columns:
        assert rows.filter_rows(df, [condition(name, ">=", "1")]).count() == 1
        assert rows.sort_rows(df, name).columns == df.columns


@pytest.mark.parametrize(
    "text, number",
    [("100", 100), (" -1.5 ", -1.5), ("1e3", 1000.0), (".5", 0.5), ("nan", None), ("inf", None), ("½", None),
     ("一", None), ("1_000", None), ("1e999", None), ("", None), (7, 7), (None, None), (True, None)],
)
def test_parse_number(text, number):
    assert parse_number(text) == number


def test_sort_puts_nulls_first_then_last(gaps):
    assert values(rows.sort_rows(gaps, "i"), "i") == [None, 1, 2]
    assert values(rows.sort_rows(gaps, "i", ""), "i") == [None, 1, 2]
    assert values(rows.sort_rows(gaps, "i", DESCENDING), "i") == [2, 1, None]
    with pytest.raises(ValueError):
        rows.sort_rows(gaps, "i,d")


def test_sort_is_global(orders):
    prices = values(rows.sort_rows(orders, "o_totalprice", DESCENDING), "o_totalprice")
    assert prices == sorted(prices, reverse=True) and len(prices) == orders.count()


def test_sort_spreads_one_hot_value(spark):
    """Equal values come from many partitions, so no task gets them all."""
    df = spark.range(0, 80_000, 1, 16).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = lambda d: [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
        spread, gathered = sizes(rows.sort_rows(df, "v")), sizes(rows.sort_rows(df, "v", spread_ties=False))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(spread) == sum(gathered) == 80_000
    assert max(gathered) > 50_000 > 25_000 > max(spread)
    assert values(rows.sort_rows(df, "v"), "v") == sorted(values(df, "v"))


def test_random_split_is_whole_and_disjoint(orders):
    first, second = rows.random_split(orders.select("o_orderkey"), 0.7, 0.3, seed=10)
    a, b = set(values(first, "o_orderkey")), set(values(second, "o_orderkey"))
    assert not a & b and a | b == set(values(orders, "o_orderkey"))
    assert 0.6 < len(a) / (len(a) + len(b)) < 0.8


def test_hash_split_ignores_the_layout(orders):
    first, _ = rows.hash_split(orders, "o_orderkey", 7, 3)
    again, rest = rows.hash_split(orders.repartition(5), ["o_orderkey"], 0.7, 0.3)
    assert set(values(first, "o_orderkey")) == set(values(again, "o_orderkey"))
    assert again.count() + rest.count() == orders.count()


def test_scatter_sample(spark, items, gaps):
    points = rows.scatter_sample(items, ["l_quantity", "l_tax"], seed=1)
    assert points.count() == 50 and points.columns == ["l_quantity", "l_tax"]
    assert rows.scatter_sample(gaps, ["i", "d"]).count() == 3
    assert "TakeOrderedAndProject" in plan_of(points)
    for columns in (["i"], ["i", "s"], ["i", "d", "i"]):
        with pytest.raises(ValueError):
            rows.scatter_sample(gaps, columns)
