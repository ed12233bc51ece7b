"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of BITS bits is cut into SEGMENTS segments. If two codes differ in r bits, the pigeonhole principle
puts floor(r / SEGMENTS) differences or fewer into some segment. Segments are indexed as they are;
a query looks up all values of a segment within a radius. After the lookups of radius s in every segment,
every code within SEGMENTS * (s + 1) - 1 differences has been met. A query is finished once its k-th best verified
distance lies within that cover; the others go on with radius s + 1. As soon as a radius would ask for more
values than a segment has, that is at full radius, all codes are covered.

Codes equal in all bits are one entry, so that copies are compared once. Ties go to the smaller id. A row is
never its own result.

Results by case: rows with a null id, a null, empty or non-finite vector have no code, are not found and find nothing; fewer
than k other rows give fewer results; repeated rows are one; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.store import Stored

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
# An index part holds the values of a segment that agree in so many leading bits, in blocks of about BLOCK codes.
LEADING = 6
BLOCK = 1 << 16
# Candidates verified at a time in a task.
STEP = 1 << 20


def sign_code(vector: str) -> Column:
    """64 bits of a vector: which of its first 64 components are above zero."""
    parts = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    code = F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when((F.size(vector) > 0) & finite, code)


def _segment(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


@lru_cache(maxsize=32)
def _masks(radius: int) -> np.ndarray:
    """All values of a segment with exactly this many bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], dtype=np.int64)


def _nearest(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of (distance, code, copies) by distance, those below whose distance at most k copies lie."""
    order = np.argsort(found[0], kind="stable")
    distance, code, copies = (x[order] for x in found)
    first = np.searchsorted(distance, distance)
    before = np.concatenate([[0], np.cumsum(copies)])[first]
    return distance[before <= k], code[before <= k], copies[before <= k]


def _met(radius: int, k: int):
    """In one index part: the codes that each query meets at exactly this segment radius, as many as it can need."""

    def rows(key: tuple, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("value", kind="stable")
        values, codes, copies = entries["value"].to_numpy(), entries["code"].to_numpy(), entries["copies"].to_numpy()
        masks, leading = _masks(radius), int(key[1])
        out = []
        for query, code, own in zip(queries["query_id"], queries["query_code"], queries["own"], strict=True):
            wanted = own ^ masks
            wanted = wanted[wanted >> (WIDTH - LEADING) == leading]
            low = np.searchsorted(values, wanted)
            sizes = np.searchsorted(values, wanted, side="right") - low
            low, sizes = low[sizes > 0], sizes[sizes > 0]
            at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            best = (np.zeros(0, np.int64),) * 3
            for a in range(0, len(at), STEP):
                some = at[a : a + STEP]
                distance = np.bitwise_count((codes[some] ^ np.int64(code)).view(np.uint64)).astype(np.int64)
                best = _nearest(tuple(np.concatenate(x) for x in zip(best, (distance, codes[some], copies[some]), strict=True)), k)
            out.append(pd.DataFrame({"query_id": query, "query_code": code, "code": best[1], "copies": best[2], "distance": best[0]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_code", "code", "copies", "distance")})

    return rows


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each query the k nearest other rows in Hamming distance.

    codes and queries: (id long, code long); null codes are left out.
    """
    if k < 1:
        raise ValueError("k: at least 1")
    stored, lasting = Stored(codes.sparkSession), Stored(codes.sparkSession)
    rows = codes.where("id is not null and code is not null").distinct()
    rows = stored.keep(rows, "codes")
    # the k + 1 smallest ids of a code are all that a query can need of it
    order = Window.partitionBy("code").orderBy("id")
    entries = rows.groupBy("code").agg(F.count("*").alias("copies"))
    segments = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), _segment(F.col("code"), i).alias("value")) for i in range(SEGMENTS)]))
    index = entries.select("code", "copies", segments.alias("s")).select("code", "copies", "s.*")
    index = stored.keep(index.withColumn("leading", F.shiftright("value", WIDTH - LEADING)), "index")
    sizes = index.groupBy("segment", "leading").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = stored.keep(sizes, "sizes")  # SEGMENTS << LEADING rows at most
    index = index.join(F.broadcast(sizes), ["segment", "leading"]).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    waiting = queries.where("id is not null and code is not null").distinct().select(F.col("id").alias("query_id"), F.col("code").alias("query_code"))
    waiting = stored.keep(waiting, "queries")
    total = rows.count()
    key = ["segment", "leading", "block"]
    met = None
    for radius in range(WIDTH + 1):
        if waiting.isEmpty():
            break
        own = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), _segment(F.col("query_code"), i).alias("own")) for i in range(SEGMENTS)]))
        asked = waiting.select("query_id", "query_code", own.alias("s")).select("query_id", "query_code", "s.*")
        # the index parts in which a value within the radius can lie
        within = F.bit_count(F.shiftright("own", WIDTH - LEADING).bitwiseXOR(F.col("leading"))) <= radius
        asked = asked.join(F.broadcast(sizes), "segment").where(within)
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        hits = asked.groupBy(*key).cogroup(index.groupBy(*key)).applyInPandas(_met(radius, k), "query_id long, query_code long, code long, copies long, distance long")
        met = stored.keep(hits if met is None else met.unionByName(hits), "hits").dropDuplicates(["query_id", "code"])
        nearer = Window.partitionBy("query_id").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        met = met.withColumn("before", F.coalesce(F.sum("copies").over(nearer), F.lit(0))).where(F.col("before") <= k).drop("before")
        met = stored.keep(met, "met")
        cover = SEGMENTS * (radius + 1) - 1
        sure = met.where(F.col("distance") <= cover).groupBy("query_id").agg(F.sum("copies").alias("n")).where((F.col("n") > k) | (F.col("n") >= total))
        waiting = stored.keep(waiting.join(sure.select("query_id"), "query_id", "left_anti"), "waiting")
    if met is None:
        return lasting.keep(codes.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int"), "top-k")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("code", F.col("id").alias("neighbor_id"))
    found = met.join(few, "code").where("neighbor_id != query_id")
    result = lasting.keep(_best(found, k).select("query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance")), "top-k")
    stored.drop()
    return result
