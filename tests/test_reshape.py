"""Splitting, merging, replacing, filling and computing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.functions.fixed_values import FILL_MAX, FILL_MEAN, FILL_MIN
from tablewright.operators import reshape


def table(df):
    return [tuple(row) for row in df.collect()]


@pytest.mark.parametrize("delimiter", ["|", ".", "$", "*", "\\", "\\E", "ab", "^", "[x]"])
def test_delimiters_are_literal(spark, delimiter):
    df = spark.createDataFrame([(f"left{delimiter}right",)], "t string")
    assert table(reshape.split_column(df, "t", delimiter, ["l", "r"]).select("l", "r")) == [("left", "right")]


def test_split_column_names_and_missing_parts(gaps):
    named = reshape.split_column(gaps, "s", "/", ["year", "月"])
    assert table(named.select("year", "月")) == [("2019", "3"), ("2019", "3"), (None, None)]
    auto = reshape.split_column(gaps, "s", "/")
    assert auto.columns[-3:] == ["s_split_1", "s_split_2", "s_split_3"]
    assert table(auto.select("s_split_3")) == [("25",), (None,), (None,)]
    first = reshape.split_column(gaps.where("i = 2"), "s", "/", [], width_from_first_row=True)
    assert first.columns[-2:] == ["s_split_1", "s_split_2"]
    with pytest.raises(ValueError):
        reshape.split_column(gaps, "s", "")


def test_split_column_of_dates(spark):
    df = spark.sql("SELECT DATE'2019-03-25' AS d")
    assert table(reshape.split_column(df, "d", "-", ["y", "m", "day"]).drop("d")) == [("2019", "03", "25")]


def test_split_rows_finds_the_first_symbol(spark):
    df = spark.createDataFrame([(1, None), (2, "x-y_z"), (3, "a_b")], "k int, t string")
    split = reshape.split_rows(df, "t")
    assert split.columns == ["k", "t", "t拆分"]
    assert sorted(table(split.select("k", "t拆分"))) == [(2, "x"), (2, "y_z"), (3, "a_b")]
    assert reshape.split_rows(df, "t", "p", "_").count() == 4
    with pytest.raises(ValueError):
        reshape.split_rows(spark.createDataFrame([("plain",)], "t string"), "t")


@pytest.mark.parametrize("symbol", ["/", "-", "_", "#", "@", "!", "$", "|", "=", ",", ".", "*"])
def test_split_rows_knows_each_symbol(spark, symbol):
    df = spark.createDataFrame([(f"p{symbol}q",)], "t string")
    assert table(reshape.split_rows(df, "t", "part").select("part")) == [("p",), ("q",)]


def test_merge_skips_nulls(gaps):
    assert table(reshape.merge_columns(gaps, ["i", "s"]).select("i_s")) == [("1,2019/3/25",), ("2,2019/3",), ("",)]
    assert "m" in reshape.merge_columns(gaps, ["i", "s"], None, "m").columns


def test_replace_is_sequential_and_keeps_positions(spark):
    df = spark.createDataFrame([("技术", 12), (None, 2)], "t string, n int")
    pairs = [{"source": "技术", "target": "电话"}, {"source": "电话", "target": "电话copy"}, {"source": "(\\d)2", "target": "$1x"}]
    replaced = reshape.replace_values(df, ["t", "n"], pairs)
    assert replaced.columns == ["t", "n"]
    assert table(replaced) == [("电话copy", "1x"), (None, "2")]


def test_fill_strategies(gaps):
    both = [{"colName": "i", "operate": FILL_MEAN}, {"colName": "d", "operate": FILL_MAX}]
    filled = reshape.fill_nulls(gaps, both)
    assert table(filled.select("i", "d")) == [(1, 1.5), (2, 1.5), (1, 1.5)]
    assert dict(filled.dtypes)["i"] == "int"
    assert table(reshape.fill_nulls(gaps, [{"colName": "s", "operate": FILL_MIN}]).select("s"))[2] == ("2019/3",)
    twice = [{"colName": "i", "operate": FILL_MAX}, {"colName": "i", "operate": FILL_MIN}]
    assert table(reshape.fill_nulls(gaps, twice).select("i"))[2] == (2,)
    with pytest.raises(ValueError):
        reshape.fill_nulls(gaps, [{"colName": "i", "operate": "unknown"}])


def test_fill_of_an_empty_column_leaves_nulls(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a int, b double")
    filled = reshape.fill_nulls(df, [{"colName": c, "operate": "mean"} for c in "ab"])
    assert table(filled) == [(None, None)]


def test_map_columns(spark):
    df = spark.createDataFrame([(10, 4, "3"), (20, 0, "x"), (None, 1, None)], "a int, b int, t string")
    entries = [
        {"colName_1": "a", "operate_1": "+", "value_1": "100", "operate": "/", "colName_2": "b",
         "operate_2": "*", "value_2": "0.5", "newName": "r"},
        {"colName_1": "r", "operate_1": "/", "value_1": 0, "colName_2": "", "newName": "z"},
        {"colName_1": "t", "operate_1": "-", "value_1": "1", "colName_2": None, "newName": "n"},
    ]
    assert table(reshape.map_columns(df, entries).select("r", "z", "n")) == [(55.0, None, 2.0), (None, None, None), (None, None, None)]
    mapped = reshape.map_columns(df.withColumn("r_2", F.lit("kept")), entries[:1])
    assert [row["r_2"] for row in mapped.collect()] == ["kept"] * 3
    for bad in ({"operate_1": "%"}, {"value_1": "many"}):
        with pytest.raises(ValueError):
            reshape.map_columns(df, [{**entries[0], **bad}])
