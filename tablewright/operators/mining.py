"""Frequent item sets and frequent sequences."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import quoted, resolve


def frequent_itemsets(
    df: DataFrame, items: str | int, *, min_support: float = 0.3, num_partitions: int | None = None
) -> DataFrame:
    """Item sets that at least this share of the baskets holds: sorted items and their count.

    Baskets are arrays; an item counts once per basket.
    """
    name = resolve(df, items)
    baskets = df.select(F.array_distinct(quoted(name)).alias("items")).where("items is not null")
    growth = FPGrowth(itemsCol="items", minSupport=min_support)
    if num_partitions is not None:
        growth.setNumPartitions(num_partitions)
    found = growth.fit(baskets).freqItemsets
    return found.select(F.array_sort("items").alias("items"), "freq")


def frequent_sequences(
    df: DataFrame,
    sequence: str | int,
    *,
    min_support: float = 0.5,
    max_pattern_length: int = 4,
    max_local_rows: int = 32_000_000,
) -> DataFrame:
    """Sequences of item sets that at least this share of the rows holds, with their count.

    A row is an array of item sets in order; a pattern may skip items between its own.
    """
    name = resolve(df, sequence)
    rows = df.select(quoted(name).alias("sequence")).where("sequence is not null")
    span = PrefixSpan(
        minSupport=min_support,
        maxPatternLength=max_pattern_length,
        maxLocalProjDBSize=max_local_rows,
        sequenceCol="sequence",
    )
    return span.findFrequentSequentialPatterns(rows)
