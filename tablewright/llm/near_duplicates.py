"""Near-duplicate documents: MinHash signatures joined by a multi-index over signature chunks.

A document is the set of its five-word shingles. Its signature has 50 symbols of 16 bits, cut into 10
chunks of 5. Two signatures that differ in at most DISTANCE symbols have, by the pigeonhole principle,
a chunk with at most one error; every chunk is therefore entered once for each place where the error may
be, under its four other symbols. All pairs within DISTANCE meet in a bucket for certain; a
pair at a similarity of exactly 0.75 meets with probability 1 - 4e-5 (a chunk agrees in 4 of 5 symbols
with p = 0.63, ten chunks), a closer pair with more.

Equal sets are one class from the start, so copies meet no bucket twice. In a bucket no pairs are
enumerated as rows: its members are first held against one pivot per bucket, links are confirmed on the full
sets, and members of different components that still share a bucket are compared on their full sets inside
tasks, in blocks, which return spanning links.

Results by case: null, empty or blank text has no shingles and links with nothing; fewer than five words
are one shingle; repeated rows and rows of equal id are one document; a null id is kept, with a null
component, and links with nothing; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.buckets import placed, resolve, shared_buckets
from tablewright.llm.buffers import named, slices, utf8
from tablewright.llm.hashing import minima, mixed, shingle_sets
from tablewright.llm.store import Stored

CHUNKS, CHUNK = 10, 5
SYMBOLS = CHUNKS * CHUNK
ERRORS = 1  # in one chunk
DISTANCE = CHUNKS * (ERRORS + 1) - 1

SIGNATURE = "id long, n long, h1 long, h2 long, sig binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(*utf8(named(part, "text")))
            sums = [(int(mixed(s).sum(dtype=np.uint64)), int(mixed(~s).sum(dtype=np.uint64))) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    named(part, "id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([x for x, _ in sums], dtype=np.uint64).view(np.int64)),
                    pa.array(np.array([x for _, x in sums], dtype=np.uint64).view(np.int64)),
                    pa.array([minima(s, SYMBOLS).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["id", "n", "h1", "h2", "sig"],
            )


def bucket_keys(signatures: list[bytes]) -> np.ndarray:
    """The bucket keys (rows x places) of signatures: one for each chunk and each place of its error."""
    chunks = np.frombuffer(b"".join(signatures), dtype=np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    keys = []
    for gone in range(CHUNK):
        key = np.zeros(chunks.shape[:2], dtype=np.uint64)
        for j in range(CHUNK):
            if j != gone:
                key = key << np.uint64(16) | chunks[:, :, j]
        salt = mixed(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(gone + 1))
        keys.append(mixed(key ^ salt))
    return placed(np.stack(keys, axis=2).reshape(len(chunks), -1))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, n): a signature under each of its bucket keys."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            keys = bucket_keys(named(part, "sig").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel()),
                    pa.array(np.repeat(named(part, "id").to_numpy(), keys.shape[1])),
                    pa.array(np.repeat(named(part, "n").to_numpy(), keys.shape[1])),
                ],
                names=["key", "id", "n"],
            )


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * common shingles >= percent * shingles of either; component_id is
    the smallest id reachable by links, kept says whether that is the document itself.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent: 75 to 100")
    stored, lasting = Stored(df.sparkSession), Stored(df.sparkSession)
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = lasting.keep(docs.mapInArrow(_signatures, SIGNATURE), "signatures")
    sized = signed.where("id is not null and n > 0")
    classes = sized.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = stored.keep(classes, "classes")

    buckets = stored.keep(shared_buckets(classes.select("id", "n", "sig").mapInArrow(_entries, "key long, id long, n long")), "buckets")
    used = classes.select("id", "sig").join(buckets.select("id").distinct(), "id")
    members = stored.keep(docs.join(used, "id").select("id", "text", "sig"), "texts")
    labels = resolve(stored, buckets, percent, members, shingle_sets, bucket_keys)
    final = classes.select("h1", "h2", F.col("id").alias("node")).join(labels, "node", "left")
    final = lasting.keep(final.select("h1", "h2", F.coalesce("component", "node").alias("component")), "classes-of")
    stored.drop()
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "id")).otherwise(F.col("id"))
    return (
        signed.join(final, ["h1", "h2"], "left")
        .select("id", "n", component.alias("component"))
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
    )
