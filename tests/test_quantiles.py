"""Exact quantiles against numpy, with bounds so small that brackets must be narrowed often."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tablewright.operators import quantiles
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.ranking import with_position

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def disc(values: np.ndarray, share: float) -> float:
    return float(np.sort(values)[max(math.ceil(round(len(values) * share, 9)) - 1, 0)])


def check(df, values, **options):
    linear, _ = exact_quantiles(df, {"v": SHARES}, **options)
    assert linear["v"] == pytest.approx([float(np.quantile(values, p)) for p in SHARES], rel=1e-12, abs=1e-12)
    found, _ = exact_quantiles(df, {"v": SHARES}, method="disc", **options)
    assert found["v"] == [disc(values, p) for p in SHARES]


def frame(spark, values, partitions=6):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(partitions)


@pytest.mark.parametrize("limit, grid", [(10**6, 1024), (200, 32)])
@pytest.mark.parametrize("shape", ["smooth", "hot", "two hot", "outliers", "constant", "few"])
def test_shapes(spark, shape, limit, grid):
    rng = np.random.default_rng(3)
    values = {
        "smooth": lambda: rng.normal(size=5000),
        "hot": lambda: np.concatenate([np.full(2000, 7.0), rng.normal(7, 3, 3000)]),
        "two hot": lambda: np.concatenate([np.full(2500, 1.0), np.full(2500, 2.0)]),
        "outliers": lambda: np.concatenate([rng.random(4990), 10.0 ** np.arange(10, 20)]),
        "constant": lambda: np.full(3000, -0.5),
        "few": lambda: rng.integers(0, 4, 5000).astype(float),
    }[shape]()
    check(frame(spark, values), values, limit=limit, grid=grid)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=300))
def test_any_values(spark, values):
    check(frame(spark, values, 3), np.array(values), limit=20, grid=8)


def test_a_wrong_bracket_is_found_and_searched_again(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = rng.normal(size=4000)
    tighten, wrong = quantiles._tighten, []

    def misled(target, *rest):
        tighten(target, *rest)
        if len(wrong) < 3:
            wrong.append(target)
            target.low, target.high = target.high + 1, target.high + 2

    monkeypatch.setattr(quantiles, "_tighten", misled)
    check(frame(spark, values), values, limit=300, grid=64)
    assert len(wrong) == 3


def test_missing_values_and_bad_arguments(spark, gaps):
    found, _ = exact_quantiles(gaps, {"d": [0.5], "i": [0.5]})
    assert found == {"d": [1.5], "i": [1.5]}
    empty, row = exact_quantiles(spark.createDataFrame([], "v double"), {"v": [0.5]})
    assert empty == {"v": [None]} and row is None
    with pytest.raises(ValueError):
        exact_quantiles(gaps, {"d": [1.5]})
    with pytest.raises(ValueError):
        exact_quantiles(gaps, {"d": [0.5]}, method="other")


def test_positions_count_through_all_partitions(spark):
    df = spark.range(0, 5000, 1, 9).selectExpr("id * 37 % 5000 AS k", "id AS payload").repartition(11)
    ranked, position = with_position(df, [df["k"]])
    assert ranked.columns == ["k", "payload", position]
    assert ranked.where(f"{position} != k").count() == 0 and ranked.count() == 5000
