"""Keys at places of an order, and pages between them."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tablewright.operators import order_statistics
from tablewright.operators.order_statistics import keys_at
from tablewright.sources import tables


@pytest.fixture
def small_rounds(monkeypatch):
    for name, value in (("FETCHED", 40), ("SAMPLE", 100), ("PIVOTS", 15)):
        monkeypatch.setattr(order_statistics, name, value)


def _ordered(df, names):
    return [tuple(r) for r in df.orderBy(*names).select(*names).collect()]


@pytest.mark.parametrize("names", [["l_shipdate", "l_orderkey", "l_linenumber"], ["l_extendedprice"], ["l_returnflag", "l_tax", "l_orderkey"]])
def test_keys_at_places(items, small_rounds, names):
    expected = _ordered(items, names)
    places = [0, 17, len(expected) // 3, len(expected) - 1]
    found = keys_at(items, names, places)
    for place, key in zip(places, found):
        assert key.before == expected.index(expected[place])
        rows = items.where(order_statistics.reaches(items, names, key.values)).orderBy(*names).limit(1).select(*names).head()
        assert tuple(rows) == expected[place]


KEYS = "i int, s string, d double, t date, x timestamp, n timestamp_ntz, m decimal(20,3), b boolean"


def test_every_type_with_nulls_and_ties(spark, small_rounds):
    draw = random.Random(3)

    def row():
        stamp = datetime(2020, 1, draw.randint(1, 28), 1, 2, 3, draw.randint(0, 5))
        values = (draw.randint(0, 3), draw.choice(["", "a", "é", "Z", "€", "\U0001f642"]), draw.choice([0.0, -1.5, float("nan"), float("inf")]), date(2020, 1, draw.randint(1, 9)), stamp, stamp, Decimal(draw.randint(-5, 5)) / 7, draw.random() < 0.5)
        return tuple(None if draw.random() < 0.2 else v for v in values)

    df = spark.createDataFrame([row() for _ in range(400)], KEYS).repartition(5).cache()
    names = df.columns
    for keys in ([n] for n in names):
        expected = [r[0] for r in df.orderBy(*keys).select(F.coalesce(F.col(keys[0]).cast("string"), F.lit("null"))).collect()]
        for start, end in ((123, 131),):
            page = tables.preview(df, start, end, order_by=keys).select(F.coalesce(F.col(keys[0]).cast("string"), F.lit("null"))).collect()
            assert [r[0] for r in page] == expected[start:end], keys
    whole = [tuple(map(str, r)) for r in df.orderBy(*names).collect()]
    page = [tuple(map(str, r)) for r in tables.preview(df, 150, 250, order_by=names).collect()]
    assert page == whole[150:250]


def test_one_key_holds_most_rows(spark, small_rounds):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.lit(50)).otherwise(F.col("id") % 100).alias("k"), "id")
    expected = [r["k"] for r in df.orderBy("k").collect()]
    for start, end in ((0, 3), (400, 700), (1_500, 1_501), (2_990, 5_000)):
        assert [r["k"] for r in tables.preview(df, start, end, order_by="k").collect()] == expected[start:end]


def test_deep_pages_are_filters(items):
    n = items.count()
    page = tables.preview(items, n - 100, n - 50, order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    plan = plan_of(page)
    assert "PushedFilters: [" in plan and "l_orderkey" in plan.split("PushedFilters: [", 1)[1].split("\n", 1)[0]
    assert "Window" not in plan and "Scan ExistingRDD" not in plan and not hasattr(tables, "SHALLOW_PAGE_END")
    assert page.count() == 50


def test_edges(spark):
    empty = spark.createDataFrame([], "a int")
    assert tables.preview(empty, 0, 10, order_by="a").count() == 0
    assert tables.preview_page(empty, 0, 10, order_by="a").length == 0
    one = spark.createDataFrame([(None,)], "a int")
    assert tables.preview(one, 0, 1, order_by="a").count() == 1 and tables.preview(one, 1, 1, order_by="a").count() == 0
    with pytest.raises(ValueError):
        keys_at(one, ["a"], [1])
