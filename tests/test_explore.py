"""Statistics, frequencies and correlations against pandas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.fixed_values import STATISTIC_LABELS
from tablewright.operators import explore


def described(df, columns, **options):
    return {row["column"]: row.asDict() for row in explore.describe(df, columns, **options).collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(
        {
            "k": np.arange(400),
            "gamma": rng.gamma(2.0, 3.0, 400),
            "whole": rng.integers(-5, 6, 400),
            "some": np.where(rng.random(400) < 0.3, np.nan, rng.normal(size=400)),
        }
    )
    return frame, spark.createDataFrame(frame).repartition(7)


def test_describe_equals_pandas(mixed):
    frame, df = mixed
    found = described(df, ["gamma", "whole", "some"], order_by="k")
    for name in ("gamma", "whole", "some"):
        s, row = frame[name], found[name]
        expected = {
            "count": s.count(), "min": s.min(), "min_position": s.idxmin(), "q25": s.quantile(0.25),
            "median": s.median(), "q75": s.quantile(0.75), "mean": s.mean(), "max": s.max(),
            "max_position": s.idxmax(), "mean_abs_dev": (s - s.mean()).abs().mean(), "variance": s.var(),
            "std": s.std(), "skewness": s.skew(), "kurtosis": s.kurt(),
        }
        for field, value in expected.items():
            assert math.isclose(row[field], value, rel_tol=1e-9, abs_tol=1e-12), (name, field)


def test_positions_take_the_first_of_equals_and_null_keys_first(spark):
    df = spark.createDataFrame([("b", 2, 5), ("a", 1, 5), ("a", None, 1), (None, 9, 1)], "g string, n int, v int")
    row = described(df, ["v"], order_by=["g", "n"])["v"]
    assert (row["min_position"], row["max_position"]) == (0, 2)


def test_small_and_constant_columns(spark):
    one = described(spark.createDataFrame([(4.0, "x")], "v double, t string"), ["v", "t"])
    assert one["v"]["std"] is None and one["v"]["skewness"] is None and one["v"]["median"] == 4.0
    assert one["t"]["type"] == "text" and one["t"]["count"] == 1 and one["t"]["min"] is None
    same = described(spark.createDataFrame([(0.1,)] * 5, "v double"), ["v"])["v"]
    assert (same["variance"], same["skewness"], same["kurtosis"], same["mean_abs_dev"]) == (0.0, 0.0, 0.0, 0.0)
    empty = described(spark.createDataFrame([(None, None)], "v double, t string"), ["v", "t"], order_by="t")
    assert empty["v"]["count"] == 0 and empty["v"]["min"] is None and empty["v"]["min_position"] is None
    none = described(spark.createDataFrame([], "v double, t string"), ["v", "t"])
    assert none["v"]["count"] == none["t"]["count"] == 0


def test_nan_counts_as_null(gaps):
    row = described(gaps, ["d"])["d"]
    assert (row["count"], row["max"], row["mean"]) == (1, 1.5, 1.5)


def test_report_shape(mixed):
    frame, df = mixed
    report = explore.describe_report(df.withColumn("t", F.lit("x")), ["whole", "t"], order_by="k").collect()
    assert [row["statistic"] for row in report] == STATISTIC_LABELS
    assert [row["whole"] for row in report][:3] == ["number", "400", str(frame["whole"].min())]
    assert [row["t"] for row in report] == ["text", "400"] + [""] * 13


def test_frequency_orders_and_drops_missing(spark, gaps):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", None]], "v string")
    assert [tuple(r) for r in explore.frequency(df, "v").collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert explore.frequency(df, "v").columns == ["v", "频率"]
    assert [tuple(r) for r in explore.frequency(gaps, "d").collect()] == [(1.5, 1)]


def test_correlation_equals_pandas(mixed):
    frame, df = mixed
    df, frame = df.withColumn("same", F.lit(0.1)), frame.assign(same=0.1)
    names = ["gamma", "some", "whole", "same"]
    expected = frame[names].corr()
    for row in explore.correlation(df, names).collect():
        value = expected.loc[row["left"], row["right"]]
        if math.isnan(value):
            assert row["correlation"] is None
        else:
            assert math.isclose(row["correlation"], value, abs_tol=1e-12)
    matrix = explore.correlation_matrix(df, names).collect()
    assert [r["column"] for r in matrix] == names and matrix[0]["gamma"] == 1.0 and matrix[3]["same"] is None


def test_correlation_wants_numbers_and_allows_empty(spark, gaps):
    with pytest.raises(ValueError):
        explore.correlation(gaps, ["i", "s"])
    empty = spark.createDataFrame([], "a double, b int")
    assert [r["correlation"] for r in explore.correlation(empty, ["a", "b"]).collect()] == [None] * 4
    assert explore.correlation(spark.createDataFrame([(1.0, 2)], "a double, b int"), [0, 1]).count() == 4
