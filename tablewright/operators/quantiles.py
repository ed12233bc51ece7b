"""Exact quantiles of large columns without gathering or sorting a column in one place.

Spark's exact percentile keeps every distinct value of the column in one aggregation buffer. Here
that buffer is bounded: a column with more values than the bound is first narrowed to a bracket
around each wanted rank, by passes that keep fixed-size quantile summaries per group of
partitions. Values outside the bracket are then clamped to its ends, which leaves the wanted ranks
as they are, and the exact aggregate runs over the few distinct values that are left. Every bracket
is checked by counting the rows below and inside it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from tablewright.functions.columns import clean_double, free_name

# Distinct values that one exact aggregation buffer may hold.
BRACKET_LIMIT = 200_000
# Summaries per pass: groups of partitions, points kept per group, and accuracy of each summary.
GROUPS, GRID, ACCURACY = 64, 1_024, 10_000


@dataclass
class _Target:
    """One wanted rank of a column and the closed bracket its value is believed to lie in."""

    column: str
    rank: int
    rows: float  # bound on the rows strictly inside the bracket
    low: float | None = None
    high: float | None = None
    slack: float = 1.0
    value: float | None = None

    def reopen(self, rows: int) -> None:
        self.low = self.high = None
        self.rows, self.slack = rows, self.slack * 4


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    *,
    counts: Mapping[str, int] | None = None,
    method: str = "linear",
    also: Mapping[str, Column] | None = None,
    limit: int = BRACKET_LIMIT,
    grid: int = GRID,
) -> tuple[dict[str, list[float | None]], Row | None]:
    """Quantiles per column, nulls and NaN left out, plus the row of the aggregates in `also`.

    `linear` interpolates between neighbours, `disc` takes the smallest value whose share of the
    rows reaches the probability. `also` is computed in the last pass, so it costs none of its own.
    """
    names = list(wanted)
    if counts is None:
        found = df.agg(*[F.count(clean_double(df, c)).alias(f"n{i}") for i, c in enumerate(names)])
        counts = dict(zip(names, found.head())) if names else {}
    places = {
        name: [_place(counts[name], p, method) for p in wanted[name]] for name in names if counts[name]
    }
    targets = {
        (name, rank): _Target(name, rank, counts[name])
        for name, found in places.items()
        for lower, upper, _ in found
        for rank in (lower, upper)
    }
    extra: Row | None = None
    while True:
        sought = [target for target in targets.values() if target.value is None]
        wide = [target for target in sought if target.rows > limit]
        if wide:
            _narrow(df, wide, counts, grid)
        elif sought or (also and extra is None):
            extra = _select(df, sought, counts, also if extra is None else None) or extra
        else:
            break

    def quantile(name: str, place: tuple[int, int, float]) -> float:
        lower, upper = (targets[name, rank].value for rank in place[:2])
        return lower + (upper - lower) * place[2] if place[2] else lower

    return {
        name: [quantile(name, place) for place in places[name]] if name in places else [None] * len(wanted[name])
        for name in names
    }, extra


def _place(n: int, probability: float, method: str) -> tuple[int, int, float]:
    """The two 0-based ranks that a quantile lies between and its way from one to the other."""
    if not 0 <= probability <= 1:
        raise ValueError(f"probability {probability} is not between 0 and 1")
    if method == "linear":
        exact = (n - 1) * probability
        lower = math.floor(exact)
        return lower, min(lower + 1, n - 1), exact - lower
    if method == "disc":
        rank = min(max(math.ceil(round(n * probability, 9)) - 1, 0), n - 1)
        return rank, rank, 0.0
    raise ValueError(f"unknown quantile method {method!r}")


def _by_bracket(targets: list[_Target]) -> dict[tuple, list[_Target]]:
    """Targets that share a column and a bracket share an aggregate."""
    brackets: dict[tuple, list[_Target]] = {}
    for target in targets:
        brackets.setdefault((target.column, target.low, target.high), []).append(target)
    return brackets


def _narrow(df: DataFrame, targets: list[_Target], counts: Mapping[str, int], grid: int) -> None:
    """One pass that settles a target at its bracket's end or shrinks the bracket to a small share.

    Only values strictly inside a bracket are summarised, so one frequent value at its end does
    not blur the others.
    """
    points = F.expr("array(" + ", ".join(f"{i / grid!r}D" for i in range(grid + 1)) + ")")
    brackets = _by_bracket(targets)
    aggregates = []
    for b, (column, low, high) in enumerate(brackets):
        value = clean_double(df, column)
        inner = value if low is None else F.when((value > low) & (value < high), value)
        aggregates += [
            F.count_if(F.lit(False) if low is None else value < low).alias(f"below{b}"),
            F.count_if(F.lit(False) if low is None else value == low).alias(f"at_low{b}"),
            F.count_if(F.lit(False) if low is None else value == high).alias(f"at_high{b}"),
            F.count(inner).alias(f"inside{b}"),
            F.percentile_approx(inner, points, ACCURACY).alias(f"points{b}"),
        ]
    group = (F.spark_partition_id() % GROUPS).alias("part_group")
    # At most GROUPS rows of fixed size, however large the table is.
    summaries = df.groupBy(group).agg(*aggregates).collect()
    for b, members in enumerate(brackets.values()):
        below, at_low, inside, at_high = (
            sum(row[f"{name}{b}"] for row in summaries) for name in ("below", "at_low", "inside", "at_high")
        )
        filled = [(row[f"inside{b}"], row[f"points{b}"]) for row in summaries if row[f"inside{b}"]]
        for target in members:
            place = target.rank - below - at_low
            if 0 <= place < inside:
                _tighten(target, place, filled, grid)
            elif -at_low <= place < 0:
                target.value = target.low
            elif target.low != target.high and inside <= place < inside + at_high:
                target.value = target.high
            else:
                target.reopen(counts[target.column])


def _tighten(target: _Target, place: int, filled: list[tuple[int, list[float]]], grid: int) -> None:
    """Move the bracket's ends to summary points that lie safely around the wanted place.

    Each group's points divide its rows into equal parts, so the rows up to a point are known to
    within one part and the summary's own error.
    """
    values = np.concatenate([points for _, points in filled])
    weights = np.concatenate([np.full(len(points), rows / grid) for rows, points in filled])
    order = np.argsort(values, kind="stable")
    values, reached = values[order], np.cumsum(weights[order])
    error = target.slack * sum(rows for rows, _ in filled) * (2 / grid + 2 / ACCURACY) + len(filled)
    first = np.searchsorted(reached, place - error, side="right") - 1
    last = np.searchsorted(reached, place + error, side="left")
    low, high = float(values[max(first, 0)]), float(values[min(last, len(values) - 1)])
    # A bracket that stays as it is holds fewer rows than the summaries have points.
    target.rows = 0 if (low, high) == (target.low, target.high) else 4 * error
    target.low, target.high = low, high


def _select(
    df: DataFrame,
    targets: list[_Target],
    counts: Mapping[str, int],
    also: Mapping[str, Column] | None,
) -> Row | None:
    """Settle all targets in one pass; a bracket that missed its rank is opened again."""
    aggregates = [column.alias(name) for name, column in (also or {}).items()]
    brackets = _by_bracket(targets)
    clamped: dict[str, Column] = {}
    for b, ((column, low, high), members) in enumerate(brackets.items()):
        value = clean_double(df, column)
        name = free_name(df, f"clamped{b}")
        clamped[name] = value
        if low is not None:
            clamped[name] = F.when(value < low, low).when(value > high, high).otherwise(value)
            aggregates.append(F.count_if(value < low).alias(f"below{b}"))
            aggregates.append(F.count_if(value > high).alias(f"above{b}"))
        ranks = [target.rank for target in members]
        aggregates.append(_values_at(name, ranks, counts[column]).alias(f"values{b}"))
    row = df.withColumns(clamped).agg(*aggregates).head()
    for b, ((column, low, _), members) in enumerate(brackets.items()):
        below, above = (0, 0) if low is None else (row[f"below{b}"], row[f"above{b}"])
        for target, value in zip(members, row[f"values{b}"]):
            if below <= target.rank < counts[column] - above:
                target.value = value
            else:
                target.reopen(counts[column])
    return row if also else None


def _values_at(name: str, ranks: list[int], rows: int) -> Column:
    """The values at 0-based ranks; a share of rank + 1/2 names one rank beyond rounding doubt."""
    shares = ", ".join(f"{(rank + 0.5) / rows!r}D" for rank in ranks)
    return F.expr(f"percentile_disc(array({shares})) WITHIN GROUP (ORDER BY `{name}`)")
