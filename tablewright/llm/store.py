"""Intermediate tables in the shared folder that the cluster names, and connected components on them."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.sources.scratch import checkpointed, scratch_path


class Stored:
    """Tables written as Parquet below spark.checkpoint.dir, dropped when no longer needed.

    A written table cuts the lineage: a lost executor costs only the tasks that it ran. keep() gives
    the table as read back; drop() deletes its files once everything made from it is written too. Tables that an
    operator's lazy result reads can't be dropped by the operator: release() deletes them when the result is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, stem: str) -> DataFrame:
        path = scratch_path(self.spark, stem)
        df.write.parquet(path)
        self.paths.append(path)
        _written.setdefault(self.spark.sparkContext.applicationId, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.paths)
        self.paths = []


# Paths that keep() has written and nothing has deleted yet, by application.
_written: dict[str, list[str]] = {}


def _delete(spark: SparkSession, paths: Collection[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    left = _written.get(spark.sparkContext.applicationId, [])
    for path in list(paths):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        if path in left:
            left.remove(path)


def kept_tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that operators of this application have kept and nothing has deleted yet."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, but: Collection[str] = ()) -> None:
    """Delete all tables that operators of this application have kept for their results, except some.

    Call it when the results are written; results that are still lazy can't be computed afterwards.
    """
    _delete(spark, [path for path in kept_tables(spark) if path not in but])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component: the smallest node reachable.

    Alternating large-star and small-star steps: every step is a grouped minimum and a join, no group
    is gathered, and the number of steps grows with the logarithm of the longest path. Each round
    is checkpointed. Nulls and loops are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u != v").distinct()
    edges = checkpointed(edges)
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lows, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a checksum of them."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return int(row[0]), int(row[1] or 0)
