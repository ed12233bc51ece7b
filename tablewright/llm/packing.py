"""Packing documents into sequences of fixed length by cutting stock.

A document's ids are cut into full sequences and one remainder. The remainders are the stock: their
length histogram goes through a linear program (cutting_stock.py), whose patterns, rounded down,
say how many sequences hold which lengths. Within each length the pieces are ranked, and ranks are dealt to
the patterns' slots. What rounding leaves over is fewer sequences than there are length classes; these pieces are
laid end to end and cut at the sequence ends, and the last sequence is cut at powers of two, which
need no padding.

Ranks are distributed: pieces are spread over salted groups of a length, counted, and the counts are summed
up to first ranks, so that a length that fills the table is never in one task.

Ids are those of the tokenizer as loaded: the literal of an added token in a text is that token's id.

Results by case: a null or empty text has the closing id alone and is one piece of one token; a null id is kept
like any other; repeated rows are packed each on their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.buffers import named, slices, utf8
from tablewright.llm.cutting_stock import GRAIN, solve
from tablewright.llm.hashing import mixed
from tablewright.llm.pretoken import cuts
from tablewright.llm.store import Stored

LENGTH = 2048
# Closes every document.
END_ID = 1
# Places for pre-tokens that a task process remembers (a power of two), and how many of their ids; beyond that it starts anew.
PLACES, IDS = 1 << 21, 1 << 22
# Bytes of the longest pre-token that is remembered.
LONGEST = 15

_masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """The pre-tokens that this process has met with a tokenizer file, in whatever task."""
    return Words(path)


class Words:
    """The ids of pre-tokens. Those met before are looked up in a table, in which a later one takes the place of an earlier one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # what it gets are pre-tokens: it needn't look for their ends again
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.ids = np.zeros(IDS, dtype=np.uint32)
        self.low, self.high = np.zeros(PLACES, dtype=np.uint64), np.zeros(PLACES, dtype=np.uint64)
        self.at, self.many = np.zeros(PLACES, dtype=np.int32), np.zeros(PLACES, dtype=np.uint8)
        self.end = 0

    def encoded(self, data: bytes, text: str, cut: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens of a text, one after the other, and where those of each begin (len + 1)."""
        start, size = places[:-1], np.diff(places)
        # 15 bytes and the length, which is never 0, are the pre-token itself
        padded = data + bytes(16)
        words = np.ndarray(len(data) + 9, dtype="<u8", buffer=padded, strides=(1,))
        low = words[start] & _masks[np.minimum(size, 8)]
        high = words[np.minimum(start + 8, len(data))] & _masks[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        hashed = mixed(low ^ mixed(high))
        place = (hashed >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
        short = size <= LONGEST
        hit = short & (self.low[place] == low) & (self.high[place] == high)

        miss = np.flatnonzero(~hit)
        first, which = np.unique(hashed[miss], return_index=True, return_inverse=True)[1:]
        chosen = miss[first]
        # long pre-tokens, and other ones of the same hash, stand for themselves
        own = np.flatnonzero(~short[miss] | (low[chosen[which]] != low[miss]) | (high[chosen[which]] != high[miss]))
        which[own] = len(chosen) + np.arange(len(own))
        chosen = np.concatenate([chosen, miss[own]])
        made, ends = self._made([text[a:b] for a, b in zip(cut[chosen].tolist(), cut[chosen + 1].tolist(), strict=True)])

        many, at = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
        many[hit], at[hit] = self.many[place[hit]], self.at[place[hit]]
        many[miss], at[miss] = np.diff(ends)[which], ends[which]
        begin = np.concatenate([[0], np.cumsum(many)])
        source = np.arange(begin[-1]) + np.repeat(at - begin[:-1], many)
        known = np.repeat(hit, many)
        out = np.empty(len(source), dtype="<u4")
        out[known] = self.ids[source[known]]
        out[~known] = made[source[~known]]

        if self.end + len(made) > IDS:
            self.high[:] = 0
            self.end = 0
        if len(made) <= IDS:
            self.ids[self.end : self.end + len(made)] = made
            new = np.flatnonzero(short[chosen])
            kept = chosen[new]
            # where two fall on one place, all columns take the same one
            last = len(kept) - 1 - np.unique(place[kept][::-1], return_index=True)[1]
            new, kept = new[last], kept[last]
            there = place[kept]
            self.low[there], self.high[there] = low[kept], high[kept]
            self.at[there], self.many[there] = self.end + ends[new], np.diff(ends)[new]
            self.end += len(made)
        return out, begin

    def _made(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        done = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(done.ids, dtype=np.uint32), np.searchsorted(np.array(done.word_ids, dtype=np.int64), np.arange(len(words) + 1))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Every batch in slices, with the id bytes of each text, the closing id included.

    Ids are little-endian unsigned 32-bit integers. The tokenizer sees the pre-tokens that the process doesn't
    remember, and as a whole each text that holds one of its added tokens.
    """
    tokenizer = tokenizer_of(path)
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    sought = [x.encode("utf-8") for x in added]
    known = words_of(path)
    last = np.array([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = utf8(named(part, "text"))
            data = raw.tobytes()
            text, cut, places, first = cuts(data, offsets)
            ids, begin = known.encoded(data, text, cut, places)
            at = begin[first].tolist()
            out = [ids[a:b].tobytes() + last for a, b in zip(at, at[1:], strict=False)]
            if any(x in data for x in sought):
                for i, text in enumerate(named(part, "text").to_pylist()):
                    if text and any(x in text for x in added):
                        out[i] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + last
            yield part, out


def _pieces(path: str, length: int):
    """Full sequences and the remainder of each document: start, length, crc."""

    def rows(batches):
        for part, texts in _encoded(batches, path):
            which, start, size, crc, total = [], [], [], [], []
            for i, ids in enumerate(texts):
                n = len(ids) // 4
                for a in range(0, n, length):
                    b = min(n, a + length)
                    which.append(i)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    total.append(n)
            made = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
            yield pa.RecordBatch.from_arrays([named(part, "id").take(pa.array(which, pa.int64())), named(part, "row").take(pa.array(which, pa.int64())), *made], names=["id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return rows


def _recut(path: str):
    """The crc of other cuts of a document: cuts is a list of (start, length, sequence_id, offset)."""

    def rows(batches):
        for part, texts in _encoded(batches, path):
            out = {k: [] for k in ("which", "start", "length", "crc", "total", "sequence_id", "offset")}
            for i, (ids, cuts) in enumerate(zip(texts, named(part, "cuts").to_pylist(), strict=True)):
                for c in cuts:
                    a, b = c["start"], c["start"] + c["length"]
                    for k, v in (("which", i), ("start", a), ("length", b - a), ("crc", zlib.crc32(ids[4 * a : 4 * b])), ("total", len(ids) // 4), ("sequence_id", c["sequence_id"]), ("offset", c["offset"])):
                        out[k].append(v)
            ids = named(part, "id").take(pa.array(out.pop("which"), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in out.values()]], names=RESULT)

    return rows


RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _plan(counts: dict[int, int], length: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Slots of the rounded patterns and the number of their sequences.

    A slot row (size, first, last, pattern, times, sequence, place): ranks first..last - 1 of the size class fill
    this pattern's places from `place` on, `times` in each sequence from number `sequence` on.
    """
    histogram = np.zeros(length // GRAIN, dtype=np.int64)
    for size, n in counts.items():
        histogram[size - 1] = n
    patterns, uses = solve(histogram, length // GRAIN)
    used = np.zeros_like(histogram)
    slots, sequence = [], 0
    for p, (pattern, use) in enumerate(zip(patterns.astype(np.int64), np.floor(uses + 1e-7).astype(np.int64), strict=True)):
        kinds = np.flatnonzero(pattern)
        use = int(min([use, *((histogram[kinds] - used[kinds]) // pattern[kinds])]))
        if use <= 0:
            continue
        place = 0
        for k in kinds:
            times = int(pattern[k])
            slots.append((int(k) + 1, int(used[k]), int(used[k]) + times * use, p, times, sequence, place))
            used[k] += times * use
            place += times
        sequence += use
    return slots, sequence


def pack(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: a byte-level tokenizer file. Pieces of a sequence lie gapless from offset 0, their total is at most
    `length`, a power of two.
    """
    if length < 2 * GRAIN or length & (length - 1):
        raise ValueError("length: a power of two")
    spark = df.sparkSession
    stored, lasting = Stored(spark), Stored(spark)
    docs = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("row", F.xxhash64("id", "text"))
    kind = docs.schema["id"].dataType.simpleString()
    pieces = docs.mapInArrow(_pieces(path, length), f"id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long")
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = F.when(F.col("length") == length, F.lit(length // GRAIN + 1)).otherwise(F.ceil(F.col("length") / GRAIN)).cast("int")
    pieces = stored.keep(pieces.select("*", size.alias("size"), F.pmod(F.xxhash64("row", "start"), F.lit(groups)).cast("int").alias("salt")), "pieces")

    # rank within a size: a group's first rank, from the counts, and the place within the group
    by_group = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_group.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["size"]: r["n"] for r in by_group.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(length // GRAIN + 1, 0)
    slots, sequences = _plan(counts, length)
    within = Window.partitionBy("size", "salt").orderBy("row", "start")
    ranked = pieces.withColumn("place", F.row_number().over(within) - 1).join(firsts, ["size", "salt"]).withColumn("rank", F.col("first") + F.col("place")).drop("first", "place", "salt")
    ranked = stored.keep(ranked, "ranked")

    alone = ranked.where(F.col("size") > length // GRAIN).select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    # at most as many rows as size classes times the classes in a pattern
    table = F.broadcast(spark.createDataFrame(slots, "slot_size int, lo long, hi long, pattern int, times int, sequence long, first_place int"))
    in_slot = (F.col("size") == F.col("slot_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    rest = ranked.where(F.col("size") <= length // GRAIN).join(table, in_slot, "left")
    turn = F.col("rank") - F.col("lo")
    placed = rest.where("pattern is not null").select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(full) + F.col("sequence") + F.floor(turn / F.col("times"))).alias("sequence_id"),
        (F.col("first_place") + F.pmod(turn, F.col("times").cast("long"))).alias("place"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    )

    # fewer sequences than size classes: their pieces end to end, cut at the sequences' ends
    left = stored.keep(rest.where("pattern is null").select("row", "start", "length", "size", "rank"), "left")
    total = int(left.agg(F.sum("length")).first()[0] or 0)
    running = Window.orderBy("size", "rank").rowsBetween(Window.unboundedPreceding, -1)
    laid = left.withColumn("from", F.coalesce(F.sum("length").over(running), F.lit(0))).withColumn("to", F.col("from") + F.col("length"))
    tail, stops = _stops(total, length)
    whole = F.lit(length).cast("long")
    # a remainder is shorter than a sequence: at most one sequence end lies in it
    inner = F.array((F.floor(F.col("from") / whole) + 1) * whole, *[F.lit(x).cast("long") for x in stops])
    marks = F.concat(F.array("from"), F.filter(F.array_distinct(inner), lambda x: (x > F.col("from")) & (x < F.col("to"))), F.array("to"))
    bits = laid.withColumn("marks", F.array_sort(marks))
    bits = bits.select("row", "start", "from", F.posexplode(F.slice("marks", 1, F.size("marks") - 1)).alias("i", "a"), "marks")
    bits = bits.select("row", "start", "from", "a", F.get("marks", F.col("i") + 1).alias("b"))
    sequence, offset = F.floor(F.col("a") / whole), F.pmod(F.col("a"), whole)
    for i, stop in enumerate(stops, 1):
        sequence = F.when(F.col("a") >= stop, F.lit(tail // length + i).cast("long")).otherwise(sequence)
        offset = F.when(F.col("a") >= stop, F.col("a") - stop).otherwise(offset)
    cut = F.struct(
        (F.col("start") + F.col("a") - F.col("from")).alias("start"), (F.col("b") - F.col("a")).alias("length"),
        (F.lit(full + sequences).cast("long") + sequence).alias("sequence_id"), offset.alias("offset"),
    )
    # equal rows have equal ids: one of them serves the cuts of all
    cuts = bits.groupBy("row").agg(F.collect_list(cut).alias("cuts"))
    again = docs.join(cuts.select("row"), "row", "left_semi").dropDuplicates(["row"]).join(cuts, "row").select("id", "text", "cuts")
    recut = again.mapInArrow(_recut(path), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    result = lasting.keep(alone.select(*RESULT).unionByName(placed.select(*RESULT)).unionByName(recut), "packed")
    stored.drop()
    return result


def _stops(total: int, length: int) -> tuple[int, list[int]]:
    """Where the last, unfilled sequence begins, and where it is cut so that all parts are powers of two."""
    tail = total - total % length
    stops, at, rest = [], tail, total - tail
    while rest:
        part = 1 << (rest.bit_length() - 1)
        at, rest = at + part, rest - part
        stops.append(at)
    return tail, stops[:-1]
