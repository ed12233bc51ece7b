"""Operators that add or change columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import (
    as_double,
    clean_double,
    data_type,
    is_numeric,
    parse_number,
    quoted,
    resolve,
    resolve_all,
)
from tablewright.functions.fixed_values import (
    FILL_MAX,
    FILL_MEAN,
    FILL_MIN,
    ROW_SPLIT_SUFFIX,
    SPLIT_SYMBOLS,
)


def _parts(column: Column, delimiter: str) -> Column:
    """Split on the delimiter taken literally."""
    if delimiter == "":
        raise ValueError("the delimiter must not be empty")
    return F.split(column.cast("string"), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def split_column(
    df: DataFrame,
    column: str | int,
    delimiter: str,
    new_columns: Sequence[str] | None = None,
    *,
    width_from_first_row: bool = False,
) -> DataFrame:
    """Add one column per part of a delimited text.

    With names, the first parts go to them, further parts are dropped and missing ones are null.
    Without, there are as many as the widest row has, or the first non-null row if asked for.
    """
    name = resolve(df, column)
    parts = _parts(quoted(name), delimiter)
    if not new_columns:
        width = F.size(parts).alias("width")
        if width_from_first_row:
            found = df.where(quoted(name).isNotNull()).select(width).head()
        else:
            found = df.agg(F.max(F.when(quoted(name).isNotNull(), width)).alias("width")).head()
        count = found["width"] if found and found["width"] else 1
        new_columns = [f"{name}_split_{i + 1}" for i in range(count)]
    return df.withColumns({new: F.get(parts, F.lit(i)) for i, new in enumerate(new_columns)})


def split_rows(
    df: DataFrame,
    column: str | int,
    new_column: str | None = None,
    delimiter: str | None = None,
) -> DataFrame:
    """One row per part of a delimited text, the original column kept; null texts drop out.

    Without a delimiter, the first known symbol in the first non-null row is taken.
    """
    name = resolve(df, column)
    if delimiter is None:
        delimiter = _first_symbol(df, name)
    return df.withColumn(new_column or name + ROW_SPLIT_SUFFIX, F.explode(_parts(quoted(name), delimiter)))


def _first_symbol(df: DataFrame, name: str) -> str:
    any_symbol = "[" + "".join(re.escape(symbol) for symbol in SPLIT_SYMBOLS) + "]"
    symbol = F.regexp_extract(quoted(name).cast("string"), any_symbol, 0).alias("symbol")
    first = df.where(quoted(name).isNotNull()).select(symbol).head()
    if first is None or not first["symbol"]:
        raise ValueError(f"column {name!r} holds no symbol to split on")
    return first["symbol"]


def merge_columns(
    df: DataFrame,
    columns: Sequence[str | int],
    connector: str | None = ",",
    new_column: str | None = None,
) -> DataFrame:
    """Join the columns' texts with a connector; nulls are left out, all null gives ''."""
    names = resolve_all(df, columns)
    joined = F.concat_ws(connector or ",", *[quoted(name).cast("string") for name in names])
    return df.withColumn(new_column or "_".join(names), joined)


def replace_values(
    df: DataFrame, columns: Sequence[str | int], pairs: Sequence[Mapping[str, str]]
) -> DataFrame:
    """Replace regular expressions in place; each {source, target} sees the result of those before."""

    def replaced(column: Column) -> Column:
        return reduce(
            lambda text, pair: F.regexp_replace(text, pair["source"], pair["target"]),
            pairs,
            column.cast("string"),
        )

    return df.withColumns({name: replaced(quoted(name)) for name in resolve_all(df, columns)})


_FILLS = {FILL_MEAN: "mean", FILL_MAX: "max", FILL_MIN: "min", "mean": "mean", "max": "max", "min": "min"}


def fill_nulls(df: DataFrame, entries: Sequence[Mapping[str, str]]) -> DataFrame:
    """Fill nulls and NaN by the column's mean, maximum or minimum, all taken in a single pass.

    An entry is {colName, operate}. The first one for a column counts. A mean put into an integer
    column loses its fraction; a column without any value stays null.
    """
    strategies: dict[str, str] = {}
    for entry in entries:
        if entry["operate"] not in _FILLS:
            raise ValueError(f"unknown fill {entry['operate']!r}")
        strategies.setdefault(resolve(df, entry["colName"]), _FILLS[entry["operate"]])
    if not strategies:
        return df
    statistics = [_fill_statistic(df, name, how).alias(name) for name, how in strategies.items()]
    values = df.agg(*statistics).head()
    return df.withColumns(
        {name: _filled(df, name, value) for name, value in zip(strategies, values)}
    )


def _fill_statistic(df: DataFrame, name: str, how: str) -> Column:
    if how == "mean":
        return F.avg(clean_double(df, name))
    value = quoted(name)
    if isinstance(data_type(df, name), (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    return F.max(value) if how == "max" else F.min(value)


def _filled(df: DataFrame, name: str, value: object) -> Column:
    kind = data_type(df, name)
    present = quoted(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        present = F.when(~F.isnan(present), present)
    if value is None:
        return present
    if isinstance(kind, T.IntegralType):
        value = int(value)
    return F.coalesce(present, F.lit(value).cast(kind))


_ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": F.try_divide,
}


def _apply(operator: str, left: Column, right: Column) -> Column:
    if operator not in _ARITHMETIC:
        raise ValueError(f"unknown arithmetic operator {operator!r}")
    return _ARITHMETIC[operator](left, right)


def map_columns(df: DataFrame, entries: Sequence[Mapping[str, str]]) -> DataFrame:
    """New columns (c1 op1 v1) op (c2 op2 v2) in double arithmetic; division by zero gives null.

    An entry is {colName_1, operate_1, value_1, operate, colName_2, operate_2, value_2, newName};
    without colName_2 only the left half is computed. Later entries may use earlier results.
    """
    for entry in entries:
        result = _half(df, entry, "1")
        if entry.get("colName_2") not in (None, ""):
            result = _apply(entry["operate"], result, _half(df, entry, "2"))
        df = df.withColumn(entry["newName"], result)
    return df


def _half(df: DataFrame, entry: Mapping[str, str], side: str) -> Column:
    name = resolve(df, entry[f"colName_{side}"])
    number = parse_number(entry[f"value_{side}"])
    if number is None:
        raise ValueError(f"{entry[f'value_{side}']!r} is no number")
    return _apply(entry[f"operate_{side}"], as_double(df, name), F.lit(float(number)))
