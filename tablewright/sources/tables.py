"""Reading, writing and looking at tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tablewright.functions.columns import balanced, holds_number, is_numeric, quoted, resolve
from tablewright.operators.order_statistics import Place, between, keys_at, literal, precedes, reaches

FORMATS = ("csv", "parquet", "json", "orc")


def read_table(
    spark: SparkSession,
    path: str,
    *,
    format: str | None = None,
    header: bool = True,
    infer: bool = True,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Lazy scan of parquet, JSON, ORC or CSV; the format follows the file ending unless given.

    Type inference of CSV costs one more pass over the files; give a schema for large ones.
    """
    kind = format or _format_of(spark, path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=header, inferSchema=infer and schema is None)
    return reader.format(kind).load(path)


def _ending(path: str) -> str | None:
    ending = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return "csv" if ending == "txt" else ending if ending in FORMATS else None


def _format_of(spark: SparkSession, path: str) -> str:
    """By the path's ending, or for a folder by the ending that its files share."""
    if ending := _ending(path):
        return ending
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [f.getPath().getName() for f in files]
    endings = {_ending(name) for name in names if not name.startswith(("_", "."))}
    if len(endings) != 1 or None in endings:
        raise ValueError(f"neither {path!r} nor its files name a format; give `format`")
    return endings.pop()


def write_table(df: DataFrame, path: str, *, format: str = "csv", mode: str = "errorifexists") -> str:
    """Write one file per partition (CSV with header); nothing passes through the driver."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}")
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
    return path


def text_length(lines: DataFrame, column: str = "value") -> DataFrame:
    """Total number of characters of a text column, one row; 0 for an empty table."""
    length = F.sum(F.length(quoted(resolve(lines, column))).cast("long"))
    return lines.agg(F.coalesce(length, F.lit(0).cast("long")).alias("total_length"))


def read_text_length(spark: SparkSession, path: str) -> DataFrame:
    """Total number of characters of a text file, line ends excluded."""
    return text_length(spark.read.text(path))


class Page(NamedTuple):
    length: int
    rows: DataFrame


def preview(df: DataFrame, start: int, end: int, *, order_by: str | int | list[str]) -> DataFrame:
    """Rows [start, end) in the order of a key, nulls first.

    The keys at both ends are searched by counting, then the page is a filter on the source and a sort of the page
    alone: pages of any depth and width read what lies between two keys, and nothing else is sorted or written. Without a unique key rows of
    equal keys come in any order. Places beyond the last row are left out.
    """
    if start < 0 or start > end:
        raise ValueError(f"illegal row range [{start}, {end})")
    length = df.count()
    return _page(df, start, min(end, length), length, _key_names(df, order_by))


def _page(df: DataFrame, start: int, end: int, length: int, names: list[str]) -> DataFrame:
    if start >= end:
        return df.limit(0)
    ends = [place for place in (start, end) if 0 < place < length]
    found = dict(zip(ends, keys_at(df, names, ends, length)))
    low, high = found.get(start), found.get(end)
    rows = between(df, names, low, high).orderBy(*[quoted(name) for name in names])
    before = 0 if low is None else low.before
    behind = length if high is None else high.before
    if (before, behind) == (start, end):
        return rows
    # Equal keys at an end: the page starts or ends among them.
    if high is not None and behind < end:
        rows = df.where(~_beyond(df, names, low, high)).orderBy(*[quoted(name) for name in names])
    return rows.offset(start - before).limit(end - start)


def _beyond(df: DataFrame, names: list[str], low: Place | None, high: Place) -> Column:
    """True for rows before the first key or after the last one."""
    equal = [quoted(n).eqNullSafe(literal(df, n, v)) for n, v in zip(names, high.values)]
    after = reaches(df, names, high.values) & ~balanced(Column.__and__, equal)
    return after if low is None else after | precedes(df, names, low.values)


def preview_page(df: DataFrame, start: int, end: int, *, order_by: str | int | list[str]) -> Page:
    """The table's row count and the rows [start, end), `end` clamped to the count."""
    length = df.count()
    end = min(end, length)
    if start < 0 or start > end:
        raise ValueError(f"illegal row range [{start}, {end})")
    return Page(length, _page(df, start, end, length, _key_names(df, order_by)))


def _key_names(df: DataFrame, order_by: str | int | list[str]) -> list[str]:
    refs = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    return [resolve(df, ref) for ref in refs]


def head_json(df: DataFrame, n: int = 50) -> DataFrame:
    """The first n rows as JSON objects without their null fields."""
    fields = F.struct(*[quoted(name).alias(name) for name in df.columns])
    return df.limit(n).select(F.to_json(fields).alias("json"))


def head_page(df: DataFrame, n: int = 50) -> Page:
    """The row count and the first n rows as JSON."""
    return Page(df.count(), head_json(df, n))


def column_listing(df: DataFrame, *, numeric_only: bool = False) -> DataFrame:
    """One row per column: name, type, numeric flag, non-null count and count of numeric values."""
    names = [name for name in df.columns if is_numeric(df, name) or not numeric_only]
    counts = []
    for i, name in enumerate(names):
        counts.append(F.count(quoted(name)).alias(f"present{i}"))
        counts.append(F.count_if(holds_number(df, name)).alias(f"numeric{i}"))
    if not counts:
        return df.sparkSession.createDataFrame([], _LISTING_SCHEMA)
    types = dict(df.dtypes)
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(types[name]).alias("type"),
            F.lit(is_numeric(df, name)).alias("is_numeric"),
            F.col(f"present{i}").alias("non_null"),
            F.col(f"numeric{i}").alias("numeric_values"),
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


_LISTING_SCHEMA = "column string, type string, is_numeric boolean, non_null long, numeric_values long"
