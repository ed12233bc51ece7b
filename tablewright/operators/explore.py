"""Exploration: full-table statistics, frequencies and correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import (
    clean_double,
    data_type,
    is_numeric,
    quoted,
    require_numeric,
    resolve,
    resolve_all,
)
from tablewright.functions.fixed_values import FREQUENCY_LABEL, STATISTIC_LABELS
from tablewright.functions.moments import sample_kurtosis, sample_skewness
from tablewright.operators.quantiles import exact_quantiles
from tablewright.sources.layout import held

QUARTILES = (0.25, 0.5, 0.75)

DESCRIBE_SCHEMA = (
    "column string, type string, count long, min double, min_position long, q25 double, "
    "median double, q75 double, mean double, max double, max_position long, "
    "mean_abs_dev double, variance double, std double, skewness double, kurtosis double"
)


def describe(
    df: DataFrame,
    columns: Sequence[str | int],
    *,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """One typed row of statistics per column; text columns have a count only.

    Positions are the 0-based places of the first minimum and maximum in the order of `order_by`,
    a unique key; without one a Spark table has no row order and they stay null. They are exact also for
    whole numbers above 2^53, which min and max show as doubles. NaN counts as null. All columns share their passes: one for the moments, one for the mean absolute deviation
    and the quartiles, one for the positions, and narrowing passes for large columns.
    """
    rows = [
        tuple(s.get(field) for field in T.StructType.fromDDL(DESCRIBE_SCHEMA).fieldNames())
        for s in _statistics(df, columns, order_by)
    ]
    return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)


def describe_report(
    df: DataFrame,
    columns: Sequence[str | int],
    *,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """The statistics as a report: one row per statistic, one text column per table column."""
    fields = T.StructType.fromDDL(DESCRIBE_SCHEMA).fieldNames()[1:]
    statistics = _statistics(df, columns, order_by)
    names = [s["column"] for s in statistics]

    def shown(s: dict, field: str) -> str:
        value = s.get(field)
        if value is None:
            return ""
        whole = field in ("min", "max") and isinstance(data_type(df, s["column"]), T.IntegralType)
        return str(int(value) if whole else value)

    rows = [
        (label, *[shown(s, field) for s in statistics])
        for label, field in zip(STATISTIC_LABELS, fields)
    ]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in ["statistic", *names]])
    return df.sparkSession.createDataFrame(rows, schema)


def _statistics(
    df: DataFrame, columns: Sequence[str | int], order_by: str | Sequence[str] | None
) -> list[dict]:
    names = resolve_all(df, columns)
    keys = [] if order_by is None else [order_by] if isinstance(order_by, str) else list(order_by)
    read = dict.fromkeys([*names, *resolve_all(df, keys)] if keys else names)
    with held(df.select(*[quoted(name) for name in read])) as table:
        return _passes(table, names, keys)


def _passes(df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> list[dict]:
    numbers = [name for name in names if is_numeric(df, name)]
    moments = _moments(df, names, numbers)
    found = []
    for name in names:
        kind = "number" if name in numbers else "text"
        found.append({"column": name, "type": kind, **moments.get(name, {"count": 0})})
    filled = [s for s in found if s["type"] == "number" and s["count"]]

    further: dict[str, Column] = {}
    exact = _extremes(df, [s["column"] for s in filled]) if keys else {}
    for i, s in enumerate(filled):
        value = clean_double(df, s["column"])
        further[f"mean_abs_dev{i}"] = F.avg(F.abs(value - F.lit(s["mean"])))
        if keys:
            key = F.struct(*[quoted(resolve(df, ref)) for ref in keys])
            for field in ("min", "max"):
                own = quoted(s["column"]) if s["column"] in exact else value
                bound = exact.get(s["column"], s)[field]
                further[f"{field}_key{i}"] = F.min(F.when(own == F.lit(bound), key))
    counts = {s["column"]: s["count"] for s in filled}
    quartiles, row = exact_quantiles(
        df, {name: QUARTILES for name in counts}, counts=counts, also=further
    )
    for i, s in enumerate(filled):
        s["q25"], s["median"], s["q75"] = quartiles[s["column"]]
        s["mean_abs_dev"] = row[f"mean_abs_dev{i}"]
    if keys and filled:
        places = df.agg(
            *[
                _rows_before(df, keys, row[f"{field}_key{i}"]).alias(f"{field}{i}")
                for i in range(len(filled))
                for field in ("min", "max")
            ]
        ).head()
        for i, s in enumerate(filled):
            s["min_position"], s["max_position"] = places[f"min{i}"], places[f"max{i}"]
    return found


# Columns whose moments are taken in one aggregate.
BATCH = 24


def _moments(df: DataFrame, names: Sequence[str], numbers: Sequence[str]) -> dict[str, dict]:
    """Counts, extremes and moments by column.

    Columns are taken in batches, each one aggregate over those columns alone: rows stay as they are, the state
    of a task is one row, and a batch's code doesn't grow with the table's width.
    """
    own = list(dict.fromkeys(names))
    found = {}
    for start in range(0, len(own), BATCH):
        batch = own[start : start + BATCH]
        aggregates = []
        for i, name in enumerate(batch):
            if name not in numbers:
                aggregates.append(F.count(quoted(name)).alias(f"count{i}"))
                continue
            value = F.col(f"v{i}")
            aggregates += [
                column.alias(f"{field}{i}")
                for field, column in (
                    ("count", F.count(value)), ("min", F.min(value)), ("max", F.max(value)), ("mean", F.avg(value)),
                    ("variance", F.var_samp(value)), ("skewness", sample_skewness(value)), ("kurtosis", sample_kurtosis(value)),
                )
            ]
        shown = [clean_double(df, name).alias(f"v{i}") if name in numbers else quoted(name) for i, name in enumerate(batch)]
        row = df.select(*shown).agg(*aggregates).head().asDict()
        for i, name in enumerate(batch):
            fields = ("min", "max", "mean", "variance", "skewness", "kurtosis") if name in numbers else ()
            found[name] = {"count": row[f"count{i}"], **{field: row[f"{field}{i}"] for field in fields}}
            if fields:
                found[name]["std"] = None if found[name]["variance"] is None else math.sqrt(found[name]["variance"])
    return found


def _extremes(df: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    """Least and greatest value of whole and decimal columns in their own type, which doubles may not hold."""
    whole = [name for name in dict.fromkeys(names) if isinstance(data_type(df, name), (T.IntegralType, T.DecimalType))]
    if not whole:
        return {}
    sides = [f(quoted(name)).alias(f"{side}{i}") for i, name in enumerate(whole) for side, f in (("min", F.min), ("max", F.max))]
    row = df.agg(*sides).head()
    return {name: {"min": row[f"min{i}"], "max": row[f"max{i}"]} for i, name in enumerate(whole)}


def _rows_before(df: DataFrame, refs: Sequence[str], key: tuple) -> Column:
    """Count of rows whose key comes before the given one, which is that row's position."""
    before, equal = F.lit(False), F.lit(True)
    for ref, bound in zip(refs, key):
        column, value = quoted(resolve(df, ref)), F.lit(bound)
        if bound is None:
            equal = equal & column.isNull()
        else:
            before = before | (equal & (column.isNull() | (column < value)))
            equal = equal & (column == value)
    return F.count(F.when(before, F.lit(1)))


def frequency(df: DataFrame, column: str | int, count_name: str = FREQUENCY_LABEL) -> DataFrame:
    """Distinct values and how often they occur, most frequent first, ties by value.

    Nulls and NaN are left out.
    """
    name = resolve(df, column)
    value = quoted(name)
    present = value.isNotNull()
    if isinstance(data_type(df, name), (T.FloatType, T.DoubleType)):
        present = present & ~F.isnan(value)
    counted = df.where(present).groupBy(value).agg(F.count("*").alias(count_name))
    return counted.orderBy(quoted(count_name).desc(), value)


def correlation(df: DataFrame, columns: Sequence[str | int]) -> DataFrame:
    """Pearson correlations in long form: left, right, correlation, for every ordered pair.

    A pair is correlated over the rows where both sides are present; a constant side gives null.
    """
    names, cells = _correlations(df, columns)
    pairs = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(_cell(i, j)).alias("cell"))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    found = cells.select(F.inline(F.array(*pairs)), "cells")
    return found.select("left", "right", F.try_element_at("cells", F.col("cell")).alias("correlation"))


def correlation_matrix(df: DataFrame, columns: Sequence[str | int]) -> DataFrame:
    """Pearson correlations as a matrix: one row and one column per chosen column."""
    names, cells = _correlations(df, columns)
    rows = [
        F.struct(
            F.lit(a).alias("column"),
            *[F.try_element_at("cells", F.lit(_cell(i, j))).alias(b) for j, b in enumerate(names)],
        )
        for i, a in enumerate(names)
    ]
    return cells.select(F.inline(F.array(*rows)))


def _cell(i: int, j: int) -> str:
    return f"{min(i, j)},{max(i, j)}"


# Products of pairs that are written out as expressions; a column looks at so many rows for its shift.
SUMS, SHIFT_ROWS = 1_200, 1_000
# A side whose variance is below this share of its mean square about the shift counts as constant.
CONSTANT, CONSTANT_WIDE = 1e-13, 1e-10


def _correlations(df: DataFrame, columns: Sequence[str | int]) -> tuple[list[str], DataFrame]:
    """One row with a map from each unordered pair of columns to its correlation.

    Every row gives the products of its pairs as a vector, 0 where a side is missing, which is summed place by
    place; with many columns the same sums are read off one matrix, see _wide(). Rows are neither multiplied nor
    shuffled, and a task sends on one row. The columns are
    shifted by a median of some first rows, which changes no correlation but keeps the sums from cancelling.
    """
    names = resolve_all(df, columns)
    require_numeric(df, names)
    own = list(dict.fromkeys(names))
    values = [clean_double(df, name) for name in own]
    first = df.select(*[value.alias(f"x{i}") for i, value in enumerate(values)]).limit(SHIFT_ROWS)
    row = first.agg(F.count("*").alias("n"), *[F.percentile(f"x{i}", 0.5).alias(f"x{i}") for i in range(len(own))]).head()
    places = {name: i for i, name in enumerate(own)}
    keys = [_cell(i, j) for i, j in combinations_with_replacement(range(len(names)), 2)]
    if not row["n"]:
        none = F.map_from_arrays(F.lit(keys), F.array_repeat(F.lit(None).cast("double"), len(keys)))
        return names, df.sparkSession.range(1).select(none.alias("cells"))
    shifts = [row[f"x{i}"] or 0.0 for i in range(len(own))]
    present = [F.when(value.isNotNull(), 1.0).otherwise(0.0) for value in values]
    shifted = [F.coalesce(value - F.lit(float(shift)), F.lit(0.0)) for value, shift in zip(values, shifts)]
    parts = df.select(*[c.alias(f"m{i}") for i, c in enumerate(present)], *[c.alias(f"x{i}") for i, c in enumerate(shifted)])
    if len(keys) * 6 > SUMS:
        return names, _wide(parts, [places[name] for name in names], keys)
    products: list[Column] = []
    for i, j in combinations_with_replacement(range(len(names)), 2):
        m, x = F.col(f"m{places[names[i]]}"), F.col(f"x{places[names[i]]}")
        o, y = F.col(f"m{places[names[j]]}"), F.col(f"x{places[names[j]]}")
        products += [m * o, x * o, m * y, x * x * o, m * y * y, x * y]
    vectors = parts.select(array_to_vector(F.array(*products)).alias("v"))
    sums = vectors.agg(Summarizer.sum(F.col("v")).alias("s")).select(vector_to_array("s").alias("sums"))
    found = F.transform(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda pair: _pearson([F.get("sums", pair * 6 + i) for i in range(6)]))
    itself = F.lit([_cell(i, i) for i in range(len(names))])
    cells = sums.select(F.map_from_arrays(F.lit(keys), found).alias("cells"))
    exact = F.transform_values("cells", lambda key, value: F.when(F.array_contains(itself, key), F.signum(value)).otherwise(value))
    return names, cells.select(exact.alias("cells"))


def _wide(parts: DataFrame, places: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """The correlations of many columns from one Gramian.

    A row's vector holds its marks of presence, its values and their squares, with 0 for what is missing. The
    products of these three kinds, summed over all rows, are all pairwise counts, sums, squares and products. Spark
    sums them as outer products in the JVM, one packed triangle for each task, whose size depends on the columns alone.
    """
    k = 1 + max(places)
    cells = [F.col(f"m{i}") for i in range(k)] + [F.col(f"x{i}") for i in range(k)] + [F.col(f"x{i}") * F.col(f"x{i}") for i in range(k)]
    blank = parts.sparkSession.range(2).select(array_to_vector(F.array_repeat(F.lit(0.0), 3 * k)).alias("z"))  # adds nothing to a product
    vectors = parts.select(array_to_vector(F.array(*cells)).alias("z")).unionByName(blank)
    with held(vectors) as rows:
        found = rows.agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("z")).alias("s")).head()["s"]
        related = np.nan_to_num(Correlation.corr(rows, "z").head()[0].toArray())
    n, mean, spread = found["count"], found["mean"].toArray(), np.sqrt(found["variance"].toArray())
    products = (n - 1) * related * np.outer(spread, spread) + n * np.outer(mean, mean)
    np.fill_diagonal(products, (n - 1) * spread**2 + n * mean**2)
    m, x, xx = (slice(a * k, (a + 1) * k) for a in range(3))
    both, left, left_square, cross = np.rint(products[m, m]), products[x, m], products[xx, m], products[x, x]
    with np.errstate(all="ignore"):
        variance = left_square - left**2 / both
        value = (cross - left * left.T / both) / np.sqrt(variance * variance.T)
    varies = variance > CONSTANT_WIDE * left_square
    value = np.where(varies & varies.T & (both > 0), np.clip(value, -1, 1), np.nan)
    np.fill_diagonal(value, np.where(np.diag(varies), 1.0, np.nan))
    pairs = combinations_with_replacement(range(len(places)), 2)
    entries = {key: (None if np.isnan(v) else float(v)) for key, (i, j) in zip(keys, pairs) for v in [value[places[i], places[j]]]}
    return parts.sparkSession.createDataFrame([(entries,)], "cells map<string,double>")


def _pearson(sums: Sequence[Column]) -> Column:
    """The correlation from counts, sums, squares and products over the rows where both sides are present."""
    n, x, y, xx, yy, xy = sums
    vx, vy, c = (a - F.try_divide(b * d, n) for a, b, d in ((xx, x, x), (yy, y, y), (xy, x, y)))
    varies = (vx > CONSTANT * xx) & (vy > CONSTANT * yy)
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c / F.sqrt(F.when(varies, vx * vy).otherwise(F.lit(1.0))))))
