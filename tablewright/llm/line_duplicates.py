"""Fuzzy line deduplication: of each component of near-equal lines the first stays.

A line is the set of its eight-character shingles, A-Z lowered, white space at its ends left out. Its signature
is one-permutation MinHash (every shingle is thrown into two of 30 bins, a bin keeps its minimum, empty bins
borrow from others in a fixed order), cut into 10 bands of 3 symbols: lines at a similarity of 0.8 meet with
p = 0.999. Pairs that meet are confirmed by the exact Jaccard similarity of their sets; distributed
union-find makes components; the line with the smallest (id, place) of its component stays.

Results by case: blank lines are never duplicates; shorter lines than a shingle match only equal ones; a null text stays null and
has no lines; rows equal in id and text are treated as one, all copies keep the same lines; a null id sorts first; an
empty table gives an empty result; other columns are passed through, and clashing names raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.buckets import placed, resolve, shared_buckets
from tablewright.llm.buffers import named, slices, utf8
from tablewright.llm.hashing import SEED, mixed, powers
from tablewright.llm.store import Stored

SHINGLE = 8  # a power of two
PERCENT = 80
BANDS, ROWS = 10, 3
BINS = BANDS * ROWS
THROWS = 2
# Members of a bucket up to which lines are compared at once, without pivots.
SMALL = 32
# Bytes of text whose arrays of shingles a core's cache still holds.
SLICE_BYTES = 1 << 17
NEW = ["n_lines", "n_removed"]

_random = np.random.default_rng(SEED)
_DONORS = np.array([_random.permutation(BINS) for _ in range(64)])
_FACTORS = _random.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
# Hashes of the code points that most texts are made of.
_MIXED_CODES = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


class Lines:
    """The lines of texts laid end to end, as spans of lowered code points without white space at their ends."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        # no byte of a longer character is a letter A-Z
        low = np.frombuffer(raw.tobytes().translate(_LOWER).decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = offsets if len(low) == len(raw) else offsets - np.searchsorted(np.flatnonzero((raw & 0xC0) == 0x80), offsets)
        breaks = np.flatnonzero(low == 10)
        # one line more than line breaks in every text
        starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(breaks, at)) + 1)
        first = np.searchsorted(self.doc, np.arange(len(at) - 1))
        self.number = np.arange(len(self.doc)) - first[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        ends = np.concatenate([starts[1:], [len(low)]]) if len(starts) else starts
        inner = np.ones(len(starts), dtype=bool)
        inner[:-1] = self.doc[1:] == self.doc[:-1]
        inner[-1:] = False
        ends = ends - inner
        solid = np.flatnonzero((low > 32) & (low != 0x85) & (low != 0xA0))
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        self.blank = a == b
        here = ~self.blank
        self.start, self.end = starts.copy(), starts.copy()
        self.start[here] = solid[a[here]]
        self.end[here] = solid[b[here] - 1] + 1
        self.codes = low
        self._mixed: np.ndarray | None = None
        self._whole: np.ndarray | None = None

    def _mixed_codes(self) -> np.ndarray:
        if self._mixed is None:
            common = not len(self.codes) or self.codes.max() < len(_MIXED_CODES)
            self._mixed = _MIXED_CODES[self.codes] if common else mixed(self.codes.astype(np.uint64) + np.uint64(1))
        return self._mixed

    def whole(self) -> np.ndarray:
        """A hash of every line."""
        if self._whole is None:
            up, down = powers(len(self.codes) + 1)
            here = np.flatnonzero(~self.blank)
            total = np.zeros(len(self.start), dtype=np.uint64)
            if len(here):
                terms = np.zeros(len(self.codes) + 1, dtype=np.uint64)
                np.multiply(self._mixed_codes(), up[: len(self.codes)], out=terms[:-1])
                # sums from every start to its end; those from an end to the next start aren't looked at
                total[here] = np.add.reduceat(terms, np.stack([self.start[here], self.end[here]], axis=1).ravel())[::2]
            self._whole = mixed(total * down[self.start] + (self.end - self.start).astype(np.uint64))
        return self._whole

    def windows(self) -> np.ndarray:
        """Hashes of all windows of SHINGLE code points."""
        return mixed(_summed(self._mixed_codes()))

    def rough_windows(self) -> np.ndarray:
        """Hashes of 32 bits, for signatures: what meets by them is confirmed."""
        x = _summed(self.codes)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        return x

    def sizes(self) -> np.ndarray:
        """How many windows lie in each line; a short line counts as one shingle."""
        return np.where(self.blank, 0, np.maximum(self.end - self.start - SHINGLE + 1, 1))

    def spread(self, window: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash) of every shingle of the chosen lines, in the order of lines, from the hashes of windows."""
        many = np.where(chosen, self.sizes(), 0)
        line = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(line)) + np.repeat(self.start - (np.cumsum(many) - many), many)
        short = chosen & (self.end - self.start < SHINGLE) & ~self.blank
        if not short.any():
            return line, window[place]
        at = short[line]
        place[at] = 0
        value = window[place] if len(window) else np.zeros(len(line), dtype=window.dtype)
        value[at] = self.whole()[line[at]].astype(window.dtype)
        return line, value


def _summed(window: np.ndarray) -> np.ndarray:
    """For every window of SHINGLE values their sum with a factor for each place."""
    size = 1
    while size < SHINGLE:
        if len(window) <= size:
            return window[:0].copy()
        longer = window[:-size] * _FACTORS[size.bit_length()].astype(window.dtype)
        longer += window[size:]
        window = longer
        size *= 2
    return window


def band_keys(lines: Lines, which: np.ndarray | None = None) -> np.ndarray:
    """The band keys (lines x BANDS) of one-permutation signatures, of all lines or of some; those of blank lines mean nothing."""
    chosen = ~lines.blank
    if which is not None:
        chosen[:] = False
        chosen[which] = True
    n = len(lines.start)
    empty = np.uint32(0xFFFFFFFF)
    best = np.full(n * BINS, empty, dtype=np.uint32)
    line, value = lines.spread(lines.rough_windows(), chosen)
    line *= BINS
    for j in range(THROWS):
        # hashes are mixed: a factor is enough for another bin and another order within it
        x = value * _FACTORS[4 + j].astype(np.uint32)
        bins = line + (((x >> np.uint32(16)) * np.uint32(BINS)) >> np.uint32(16))
        x &= np.uint32(0xFFFFFFFE)
        np.minimum.at(best, bins, x)
    best = best.reshape(n, BINS)
    if which is not None:
        best, n = best[which], len(which)
    open_rows = np.flatnonzero((best == empty).any(axis=1))
    for donors in _DONORS:
        if not len(open_rows):
            break
        rows = best[open_rows]
        rows = np.where(rows == empty, rows[:, donors], rows)
        best[open_rows] = rows
        open_rows = open_rows[(rows == empty).any(axis=1)]
    if len(open_rows):
        rows = best[open_rows]
        best[open_rows] = np.where(rows == empty, rows.min(axis=1, keepdims=True), rows)
    key = np.tile(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (n, 1))
    for j in range(ROWS):
        key = mixed(key ^ best[:, j::ROWS].astype(np.uint64))
    return placed(key)


def _bucket_keys(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype=np.int64).reshape(-1, BANDS)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that isn't blank: its hash and place, and at its first place in a slice its band keys (elsewhere none)."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            lines = Lines(*utf8(named(part, "text")))
            use = np.flatnonzero(~lines.blank)
            doc = pa.array(lines.doc[use])
            whole = lines.whole()[use]
            first = np.sort(np.unique(whole, return_index=True)[1])
            ends = np.zeros(len(use) + 1, dtype=np.int32)
            ends[first + 1] = BANDS
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(band_keys(lines, use[first]).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole.view(np.int64)), named(part, "id").take(doc), named(part, "row").take(doc), pa.array(lines.number[use]), keys],
                names=["line", "id", "row", "number", "keys"],
            )


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of texts: (id, text, sig) with the line's hash as id and its band keys as sig."""
    for batch in batches:
        for part in slices(batch, "text"):
            out = {}
            for text, wanted in zip(named(part, "text").to_pylist(), named(part, "wanted").to_pylist(), strict=True):
                lines = text.split("\n")
                out |= {w["line"]: lines[w["number"]] for w in wanted}
            texts = pa.array(list(out.values()), pa.string())
            keys = band_keys(Lines(*utf8(texts)))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), texts, pa.array([x.tobytes() for x in keys], pa.binary())], names=["id", "text", "sig"])


def line_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of texts of one line each."""
    lines = Lines(raw, offsets)
    line, value = lines.spread(lines.windows(), ~lines.blank)
    ends = np.searchsorted(line, np.arange(len(lines.start) + 1))
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        value[a:b].sort()
    new = np.ones(len(line), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (line[1:] != line[:-1])
    value = value[new]
    ends = np.concatenate([[0], np.cumsum(new)])[ends].tolist()
    return [value[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _without(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, removed = named(batch, "text"), named(batch, "removed")
        counts = pc.fill_null(pc.add(pc.count_substring(text, "\n").cast(pa.int64()), 1), 0)
        gone = pc.fill_null(pc.list_value_length(removed).cast(pa.int64()), 0)
        cut = pc.greater(gone, 0)
        shorter = []
        for whole, numbers in zip(text.filter(cut).to_pylist(), removed.filter(cut).to_pylist(), strict=True):
            drop = set(numbers)
            shorter.append("\n".join(x for i, x in enumerate(whole.split("\n")) if i not in drop))
        texts = pc.replace_with_mask(text, cut, pa.array(shorter, text.type))
        made = {"text": texts, "n_lines": counts, "n_removed": gone}
        yield pa.RecordBatch.from_arrays([made[c] if c in made else named(batch, c) for c in names], names=names)


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """All rows and columns of df with the text's repeated lines left out, and n_lines (before) and n_removed."""
    if clash := {c.lower() for c in df.columns} & {*NEW, "removed", "row"}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    if not 75 <= percent <= 100:
        raise ValueError("percent: 75 to 100")
    stored, lasting = Stored(df.sparkSession), Stored(df.sparkSession)
    row = F.xxhash64(id, text)
    docs = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), row.alias("row"))
    kind = docs.schema["id"].dataType.simpleString()
    lines = stored.keep(docs.mapInArrow(_lines, f"line long, id {kind}, row long, number long, keys array<long>"), "lines")
    entries = lines.select(F.explode("keys").alias("key"), F.col("line").alias("id"))
    # sizes of sets aren't known before lines are compared: all count as equal
    buckets = stored.keep(shared_buckets(entries).withColumn("n", F.lit(1).cast("long")), "buckets")
    lines = lines.drop("keys")

    members = buckets.select(F.col("id").alias("line")).distinct()
    # where one side is a small part of the other, a map of it spares the sort of lines and texts
    homes = lines.join(members.hint("shuffle_hash"), "line").groupBy("line").agg(F.min(F.struct("row", "number")).alias("home"))
    wanted = homes.groupBy(F.col("home.row").alias("row")).agg(F.collect_set(F.struct("line", F.col("home.number").alias("number"))).alias("wanted"))
    texts = docs.select("row", "text").join(wanted.hint("shuffle_hash"), "row").select("text", "wanted").mapInArrow(_picked, "id long, text string, sig binary")
    texts = stored.keep(texts.groupBy("id").agg(F.min("text").alias("text"), F.min("sig").alias("sig")), "line-texts")

    labels = resolve(stored, buckets, percent, texts, line_sets, _bucket_keys, SMALL).withColumnRenamed("node", "line")
    grouped = lines.join(labels, "line", "left").withColumn("group", F.coalesce("component", "line"))
    grouped = stored.keep(grouped.select("group", "id", "row", "number"), "grouped")
    several = grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    repeated = stored.keep(grouped.join(several.hint("shuffle_hash"), "group"), "repeated")
    keepers = repeated.groupBy("group").agg(F.min(F.struct("id", "row", "number")).alias("kept"))
    gone = repeated.join(keepers.hint("shuffle_hash"), "group").where("not (row = kept.row and number = kept.number)")
    gone = lasting.keep(gone.groupBy("row").agg(F.collect_set("number").alias("removed")), "removed")
    stored.drop()

    names = [*df.columns, *NEW]
    out = df.withColumn("row", row).join(gone.hint("shuffle_hash"), "row", "left").drop("row").withColumnRenamed(text, "text")
    fields = ", ".join(f"`{'text' if c == text else c}` {'string' if c == text else t}" for c, t in df.dtypes)
    inner = ["text" if c == text else c for c in names]
    done = out.mapInArrow(lambda batches: _without(batches, inner), f"{fields}, n_lines long, n_removed long")
    return done.withColumnRenamed("text", text)
