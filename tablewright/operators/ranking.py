"""Global row positions without gathering the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import free_name
from tablewright.sources.scratch import checkpointed

# monotonically_increasing_id keeps the partition number above this bit and the row number below.
_ROW_BITS = 33


def with_position(df: DataFrame, keys: Sequence[Column]) -> tuple[DataFrame, str]:
    """The table sorted by `keys` with a 0-based position column, and that column's name.

    The range-sorted table is checkpointed, so its partitions stay as they are. Each row's position
    is its number within the partition plus the sizes of the partitions before it; the only
    window without a key runs over one row per partition.
    """
    position = free_name(df, "position")
    part = free_name(df, "part")
    before = free_name(df, "before")
    ranged = checkpointed(df.orderBy(*keys)).withColumn(position, F.monotonically_increasing_id())
    ranged = ranged.withColumn(part, F.shiftright(position, _ROW_BITS))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part).agg(F.count("*").alias("size"))
    offsets = sizes.select(part, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias(before))
    row = F.col(position).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ranked = ranged.join(F.broadcast(offsets), part).withColumn(position, F.col(before) + row)
    return ranked.drop(part, before), position
