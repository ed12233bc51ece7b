"""Column references, type checks and ANSI-safe casts shared by all operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from decimal import Decimal

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

_DECIMAL_LITERAL = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", re.ASCII)
_LONG_MIN, _LONG_MAX = -(2**63), 2**63 - 1


def quoted(name: str) -> Column:
    """A column by its exact name, also when it holds spaces, dots, slashes or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(df: DataFrame, ref: str | int) -> str:
    """Name of the column given by name or by ordinal."""
    if isinstance(ref, int) and not isinstance(ref, bool):
        if not 0 <= ref < len(df.columns):
            raise ValueError(f"no column number {ref}: the table has {len(df.columns)} columns")
        return df.columns[ref]
    if ref not in df.columns:
        raise ValueError(f"no column {ref!r} in {df.columns}")
    return ref


def resolve_all(df: DataFrame, refs: Iterable[str | int]) -> list[str]:
    if isinstance(refs, (str, int)):
        refs = [refs]
    names = [resolve(df, ref) for ref in refs]
    if not names:
        raise ValueError("at least one column is needed")
    return names


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not use yet."""
    taken = {name.lower() for name in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if is_numeric(df, name)]


def is_vector(df: DataFrame, name: str) -> bool:
    """True for a feature column: a vector, or an array of numbers."""
    kind = data_type(df, name)
    return isinstance(kind, VectorUDT) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType))


def _array(df: DataFrame, name: str) -> Column:
    return vector_to_array(quoted(name)) if isinstance(data_type(df, name), VectorUDT) else quoted(name).cast("array<double>")


def width(df: DataFrame, name: str) -> int:
    """The width of a feature column: that of the first row that has it."""
    array = _array(df, name)
    first = df.select(F.size(array).alias("width")).where(array.isNotNull()).head()
    return 0 if first is None else first["width"]


def elements(df: DataFrame, name: str, size: int | None = None) -> list[Column]:
    """The elements of a feature column as doubles; its width is looked up unless given.

    In rows of another width all elements are null.
    """
    size = width(df, name) if size is None else size
    array = _array(df, name)
    same = F.when(F.size(array) == size, array)
    return [F.get(same, F.lit(i)) for i in range(size)]


def balanced(join: Callable[[Column, Column], Column], parts: Sequence[Column]) -> Column:
    """The parts joined pairwise, so that the expression is as deep as the logarithm of their number."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def require_numeric(df: DataFrame, names: Iterable[str]) -> None:
    for name in names:
        if not is_numeric(df, name):
            raise ValueError(f"column {name!r} must be numeric, it is {data_type(df, name).simpleString()}")


def parse_number(text: object) -> int | float | None:
    """The finite decimal number that a literal spells, else None."""
    if isinstance(text, bool) or text is None:
        return None
    if isinstance(text, (int, float, Decimal)):
        text = str(text)
    if not _DECIMAL_LITERAL.fullmatch(text):
        return None
    if re.fullmatch(r"\s*[+-]?\d+\s*", text, re.ASCII) and _LONG_MIN <= int(text) <= _LONG_MAX:
        return int(text)
    number = float(text)
    return number if abs(number) != float("inf") else None


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no number becomes null instead of an error."""
    column = quoted(name)
    if isinstance(data_type(df, name), T.DoubleType):
        return column
    if is_numeric(df, name) or isinstance(data_type(df, name), T.BooleanType):
        return column.cast("double")
    return column.cast("string").try_cast("double")


def clean_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null, as statistics need it."""
    value = as_double(df, name)
    if isinstance(data_type(df, name), (T.IntegralType, T.DecimalType)):
        return value
    return F.when(~F.isnan(value), value)


def holds_number(df: DataFrame, name: str) -> Column:
    """True where the column holds a finite number, or text that spells one."""
    column, kind = quoted(name), data_type(df, name)
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return column.isNotNull()
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        column = column.cast("string").try_cast("double")
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def lenient_double(df: DataFrame, name: str) -> Column:
    """The column as double, 0.0 where it holds no number."""
    return F.coalesce(as_double(df, name), F.lit(0.0))
