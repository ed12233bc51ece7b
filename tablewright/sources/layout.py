"""How a table that is passed over several times lies on the cluster."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F


# What a task should read at most of a table that it goes over with its own copy of each row.
PART_BYTES = 256_000_000


def spread(df: DataFrame, row_bytes: int | None = None) -> DataFrame:
    """The table in no fewer partitions than it has; one with rows in fewer than the session has cores is dealt out to them.

    With the bytes that a row takes where it is worked on, a table with a partition above PART_BYTES is dealt out to as
    many as keep each below: a file's split holds many more rows than that, if the table is wide and few columns are taken.
    Counting the partitions reads no columns, but takes what the table is made from once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("part")).count()
    filled, most, rows = sizes.agg(F.count("*"), F.max("count"), F.sum("count")).head()
    wanted = cores
    if row_bytes and filled and most * row_bytes > PART_BYTES:
        wanted = max(cores, filled + 1, math.ceil(rows * row_bytes / PART_BYTES))
    return df.repartition(wanted) if filled < wanted else df


@contextmanager
def held(df: DataFrame, row_bytes: int | None = None) -> Iterator[DataFrame]:
    """The table spread and kept while several passes go over it.

    The copy is as large as the columns chosen, in memory and on the executors' disks. All passes see the same rows, also
    after an executor is lost if the table's plan gives the same rows again; otherwise write it down first.
    """
    first = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept = first
    try:
        kept = spread(first, row_bytes)
        if kept is not first:
            kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
            kept.count()
            first.unpersist()
        yield kept
    finally:
        kept.unpersist()
        first.unpersist()
