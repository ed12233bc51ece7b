"""Byte-level BPE over whole texts: scan for token slices, merge each distinct slice once, keep offsets.

encode() turns a table of texts into ids with the byte offset of every id; decode() turns ids back into
bytes. A null text counts as empty and has no ids. Other columns are passed through untouched; names that
clash with the new columns raise. Equal slices are merged once per task process (the cache has a fixed size).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tablewright.llm.buffers import named, slices, utf8
from tablewright.llm.pretoken import split

# Distinct slices that a task process remembers; beyond that it starts anew.
CACHE_SLICES = 1 << 19
# Slices longer than this are merged with a heap.
LONG_SLICE = 64


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def bytes_of(path: str) -> list[bytes]:
    """Token bytes by id."""
    ranks = ranks_of(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: the adjacent pair of lowest rank is merged first, the leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG_SLICE:
        return _merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pairs = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[x] for x in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at])


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a linked list and a heap, for slices of any length."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n:
            r = ranks.get(piece[a : end[b]])
            if r is not None:
                heapq.heappush(heap, (r, a, end[b]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, stop = heapq.heappop(heap)
        if not alive[a] or end[a] >= n or end[end[a]] != stop:
            continue
        alive[end[a]] = False
        end[a] = stop
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    ids, a = [], 0
    while a < n:
        ids.append(ranks[piece[a : end[a]]])
        a = end[a]
    return ids


class Slices(dict):
    """Remembers what `make` returns for each slice, up to a fixed number of slices."""

    def __init__(self, make: Callable[[str], object]):
        self.make = make

    def __missing__(self, key: str):
        if len(self) >= CACHE_SLICES:
            self.clear()
        self[key] = out = self.make(key)
        return out


def _rows(path: str, batches: Iterator[pa.RecordBatch], text: str, digest: bool, names: list[str]):
    ranks, table = ranks_of(path), bytes_of(path)

    def make(piece: str):
        ids = merged(piece.encode("utf-8"), ranks)
        return (ids, ",".join(map(str, ids)))

    cache = Slices(make)
    for batch in batches:
        for part in slices(batch, text):
            raw, offsets = utf8(named(part, text))
            words, first = split(raw.tobytes(), offsets)
            got = [cache[w] for w in words]
            at = first.tolist()
            columns = {f.name: named(part, f.name) for f in part.schema if f.name != text or not digest}
            if digest:
                found = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                for a, b in zip(at, at[1:], strict=False):
                    mine = got[a:b]
                    ids = [i for x in mine for i in x[0]]
                    found["n_tokens"].append(len(ids))
                    found["ids_sha256"].append(hashlib.sha256(",".join([x[1] for x in mine]).encode()).hexdigest())
                    found["decoded_sha256"].append(hashlib.sha256(b"".join([table[i] for i in ids])).hexdigest())
                made = [pa.array(found["n_tokens"], pa.int64()), pa.array(found["ids_sha256"]), pa.array(found["decoded_sha256"])]
            else:
                ids = [[i for x in got[a:b] for i in x[0]] for a, b in zip(at, at[1:], strict=False)]
                widths = [np.cumsum([0, *[len(table[i]) for i in x[:-1]]])[: len(x)].tolist() for x in ids]
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array(widths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns.values(), *made], names=names)


def _checked(df: DataFrame, text: str, new: list[str]) -> None:
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    if clash := {c.lower() for c in df.columns} & set(new):
        raise ValueError(f"columns {sorted(clash)} exist already")


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns, with ids (array of int) and id_offsets (byte offset of each id in the text's UTF-8)."""
    _checked(df, text, ["ids", "id_offsets"])
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("id_offsets", T.ArrayType(T.LongType()))])
    names = schema.names
    return df.mapInArrow(lambda batches: _rows(path, batches, text, False, names), schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns, with decoded (binary): the bytes of the ids; null ids count as none."""
    _checked(df, ids, ["decoded"])
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def rows(batches):
        table = bytes_of(path)
        for batch in batches:
            made = [b"".join([table[i] for i in x or []]) for x in named(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return df.mapInArrow(rows, schema)


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode() and decode() of every text, reported as number of ids and hashes of ids and decoded bytes.

    Ids are written in decimal, joined by commas. The text itself is left out of the result.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    _checked(df, text, new)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(new[0], T.LongType()), *[T.StructField(c, T.StringType()) for c in new[1:]]])
    names = schema.names
    return df.mapInArrow(lambda batches: _rows(path, batches, text, True, names), schema)
