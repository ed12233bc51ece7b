"""Operators that keep, order or divide rows."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import (
    as_double,
    data_type,
    free_name,
    is_numeric,
    parse_number,
    quoted,
    require_numeric,
    resolve,
    resolve_all,
)
from tablewright.functions.fixed_values import ASCENDING, DESCENDING

_COMPARISONS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
}


def filter_rows(df: DataFrame, conditions: Sequence[Mapping[str, str]]) -> DataFrame:
    """Keep the rows that meet a flat list of conditions.

    A condition is {colName, operate, value, relation}; `relation` (AND / OR) links it to the next
    one and is empty on the last. As in SQL, AND binds tighter than OR.
    """
    return df.where(_predicate(df, conditions))


def filter_chain(df: DataFrame, steps: Sequence[Sequence[Mapping[str, str]]]) -> DataFrame:
    """Apply several condition lists one after another."""
    return reduce(filter_rows, steps, df)


def _predicate(df: DataFrame, conditions: Sequence[Mapping[str, str]]) -> Column:
    if not conditions:
        raise ValueError("a filter needs at least one condition")
    *inner, last = [(c.get("relation") or "").strip().upper() for c in conditions]
    if last or any(word not in ("AND", "OR") for word in inner):
        raise ValueError("conditions must be linked by AND or OR, and the last by nothing")
    alternatives = [[]]
    for condition, word in zip(conditions, [*inner, ""]):
        alternatives[-1].append(_comparison(df, condition))
        if word == "OR":
            alternatives.append([])
    return reduce(Column.__or__, [reduce(Column.__and__, group) for group in alternatives])


def _comparison(df: DataFrame, condition: Mapping[str, str]) -> Column:
    name = resolve(df, condition["colName"])
    operator = str(condition["operate"]).strip().upper()
    value = condition["value"]
    if operator in ("LIKE", "RLIKE"):
        text = quoted(name).cast("string")
        return text.like(str(value)) if operator == "LIKE" else text.rlike(str(value))
    if operator not in _COMPARISONS:
        raise ValueError(f"unknown comparison {condition['operate']!r}")
    column, literal = _operands(df, name, value)
    return _COMPARISONS[operator](column, literal)


def _operands(df: DataFrame, name: str, value: str) -> tuple[Column, Column]:
    """Both sides in one type, with the bare column on the left where it can reach the scan."""
    kind = data_type(df, name)
    number = parse_number(value)
    if number is not None:
        plain = is_numeric(df, name)
        return (quoted(name) if plain else as_double(df, name)), F.lit(number)
    if is_numeric(df, name):
        return as_double(df, name), F.lit(None).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return quoted(name), F.lit(str(value)).try_cast(kind)
    return quoted(name).cast("string"), F.lit(str(value))


def sort_rows(
    df: DataFrame,
    column: str | int,
    direction: str | None = ASCENDING,
    *,
    spread_ties: bool = True,
) -> DataFrame:
    """Global sort by one column: nulls first ascending, last descending.

    Rows with equal values may come in any order. `spread_ties` breaks ties by the partition a row
    comes from, so the range partitioner can divide one very frequent value among many tasks.
    """
    if isinstance(column, str) and column not in df.columns and "," in column:
        raise ValueError("rows can be sorted by one column only")
    key = quoted(resolve(df, column))
    ordered = key.desc_nulls_last() if direction in (DESCENDING, "desc") else key.asc_nulls_first()
    if not spread_ties:
        return df.orderBy(ordered)
    origin = free_name(df, "origin")
    return df.withColumn(origin, F.spark_partition_id()).orderBy(ordered, origin).drop(origin)


def random_split(
    df: DataFrame, proportion1: float, proportion2: float, seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint random parts; the split follows the partition layout, see `hash_split`."""
    first, second = df.randomSplit([float(proportion1), float(proportion2)], seed=seed)
    return first, second


def hash_split(
    df: DataFrame, key: str | int | Sequence[str], proportion1: float, proportion2: float
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by a hash of the key: the same rows on any layout and in any rerun."""
    refs = key if isinstance(key, (list, tuple)) else [key]
    parts = [F.coalesce(quoted(name).cast("string"), F.lit("")) for name in resolve_all(df, refs)]
    digest = F.substring(F.md5(F.concat_ws("\u0001", *parts)), 1, 8)
    bucket = F.conv(digest, 16, 10).cast("long") % 10_000
    share = round(10_000 * float(proportion1) / (float(proportion1) + float(proportion2)))
    return df.where(bucket < share), df.where(bucket >= share)


def scatter_sample(
    df: DataFrame, columns: Sequence[str | int], n: int = 50, seed: int | None = None, *, key: str | int | Sequence[str] | None = None
) -> DataFrame:
    """Up to n random points of two numeric columns, drawn without replacement.

    The points are those whose keys have the smallest hashes, so that a seed draws the same points on any layout and in
    any rerun, and samples of parts of a table merge into that of the whole. `key` names columns that tell rows
    apart; without it all columns do, and rows that are equal in all of them are drawn together.
    """
    if len(columns) != 2:
        raise ValueError("a scatter sample needs exactly two columns")
    names = resolve_all(df, columns)
    require_numeric(df, names)
    refs = df.columns if key is None else key if isinstance(key, (list, tuple)) else [key]
    parts = [F.coalesce(quoted(name).cast("string"), F.lit("")) for name in resolve_all(df, refs)]
    salt = random.randrange(1 << 32) if seed is None else seed
    draw = F.md5(F.concat_ws("\u0001", F.lit(str(salt)), *parts))
    hashed = free_name(df, "draw")
    points = df.select(*[quoted(name) for name in names], draw.alias(hashed))
    return points.orderBy(hashed).limit(n).drop(hashed)
