"""Audit of how the sources of each language differ in their words, by hash-consed segment trees over term ids.

Terms are counted by language and source; each language keeps those that stand in at least MIN_DOCS of its documents
and numbers them by descending count. A group of language and source is then an array of counts over these ids, cut
into segments of SEGMENT ids. Over each segment stands a binary tree of counts, built for all groups of a task at
once: subtrees with the same counts are the same node, so that the empty stretches and the small counts of rare
terms are stored once. Two groups are compared by walking both trees at the same time. Each pair of nodes is opened
once, with the number of times that it occurs, and pairs of roots are remembered, whichever groups they come
from; only distinct pairs of counts are priced at the leaves.

A task gets one segment and two blocks of BLOCK groups at most, so its memory is bounded by 2 * BLOCK * SEGMENT counts
for any vocabulary and any number of sources. Segment sums are added by Spark. Arithmetic is exact: shares are whole
numbers, sums of 64-bit prices are carried in two halves.

Results by case: null texts, languages and sources count as ''; repeated rows are documents of their own; tied
values are ranked by the item's UTF-8 bytes; a language without kept terms has shares of nothing and pair values
of 0; further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.store import Stored
from tablewright.operators.ranking import with_position

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
# Ids in a segment (a power of two), groups in a block, and counted terms that a task holds before it passes them on.
SEGMENT, BLOCK, HELD = 1 << 12, 32, 400_000

# Bytes of a term: ASCII letters, lowered, and all bytes beyond ASCII; every other byte parts terms.
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of a partition, added up as far as HELD allows; '' as the term keeps empty groups."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            n = len(terms)
            columns = [
                pa.array([lang] * n), pa.array([source] * n), pa.array(list(terms), pa.binary()).cast(pa.string()),
                pa.array([x[0] for x in terms.values()], pa.int64()), pa.array([x[1] for x in terms.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts, langs, sources = (batch.column(i).to_pylist() for i in range(3))
        for text, lang, source in zip(texts, langs, sources, strict=True):
            terms = held.setdefault((lang, source), {b"": [0, 0]})
            size -= len(terms)
            own: dict[bytes, int] = {}
            for term in text.translate(_SIGNS).split():
                own[term] = own.get(term, 0) + 1
            for term, n in own.items():
                entry = terms.get(term)
                if entry is None:
                    terms[term] = [n, 1]
                else:
                    entry[0] += n
                    entry[1] += 1
            size += len(terms)
            if size > HELD:
                yield from passed_on()
                held.clear()
                size = 0
    yield from passed_on()


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; one row with an empty term for each group."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(blank(text).cast("binary").alias("text"), blank(lang).alias("lang"), blank(source).alias("source"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    return 1 + F.call_function("div", wide, F.nullif(total + kept, F.lit(0).cast("long")).cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# --- trees --------------------------------------------------------------------------------------


def build_trees(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hash-consed trees over the rows of a matrix whose width is a power of two.

    Returns the distinct counts, for each level from the leaves' parents up the two children of every distinct node,
    and the root of every row. Equal subtrees, in one row or in several, are one node.
    """
    values, ids = np.unique(counts, return_inverse=True)
    ids = ids.reshape(counts.shape).astype(np.int64)
    levels, size = [], len(values)
    while ids.shape[1] > 1:
        pairs, found = np.unique(ids[:, ::2] * size + ids[:, 1::2], return_inverse=True)
        levels.append(np.stack([pairs // size, pairs % size], axis=1))
        ids, size = found.reshape(len(counts), -1).astype(np.int64), len(pairs)
    return values, levels, ids[:, 0]


def walk(levels: list[np.ndarray], left: int, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of leaves below two nodes of the top level, and how often each occurs; equal pairs are opened once."""
    a, b, times = np.array([left]), np.array([right]), np.array([1])
    for children in reversed(levels):
        a, b = children[a].ravel(), children[b].ravel()
        times = np.repeat(times, 2)
        size = int(b.max()) + 1
        pairs, found = np.unique(a * size + b, return_inverse=True)
        times = np.bincount(found, weights=times, minlength=len(pairs)).astype(np.int64)
        a, b = pairs // size, pairs % size
    return a, b, times


def _shares(values: np.ndarray, total: int, kept: int) -> np.ndarray:
    return np.array([1 + SCALE * (int(c) + 1) // (total + kept) for c in values], dtype=np.int64)


def _priced(pdf: pd.DataFrame) -> pd.DataFrame:
    """Prices of all pairs of groups in one segment and one pair of blocks, both ways, as high and low halves."""
    counts = np.zeros((len(pdf), SEGMENT), dtype=np.int64)
    for row, (at, n) in enumerate(zip(pdf["at"], pdf["n"], strict=True)):
        counts[row, np.asarray(at, dtype=np.int64)] = n
    values, levels, roots = build_trees(counts)
    width = int(pdf["width"].iloc[0])  # ids in use; what lies beyond is no term
    shares = [_shares(values, int(total), int(kept)) for total, kept in zip(pdf["total"], pdf["kept"], strict=True)]
    sources, blocks = pdf["source"].tolist(), pdf["block"].to_numpy()
    one_block = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    met: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    zero = int(np.searchsorted(values, 0)) if width < SEGMENT else -1
    out = []
    for x in range(len(sources)):
        for y in range(x + 1, len(sources)):
            if not one_block and blocks[x] == blocks[y]:
                continue
            key = (int(roots[x]), int(roots[y]))
            if key not in met:
                a, b, times = walk(levels, *key)
                if zero >= 0:
                    times = times - np.where((a == zero) & (b == zero), SEGMENT - width, 0)
                met[key] = a, b, times
            a, b, times = met[key]
            p, q = shares[x][a], shares[y][b]
            square = (p - q) * (p - q)
            for source, item, base in ((sources[x], sources[y], q), (sources[y], sources[x], p)):
                f = square // base
                out.append((source, item, int(((f >> 32) * times).sum()), int(((f & 0xFFFFFFFF) * times).sum())))
    lang = pdf["lang"].iloc[0]
    return pd.DataFrame([(lang, *row) for row in out], columns=["lang", "source", "item", "high", "low"])


# --- audit --------------------------------------------------------------------------------------


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group its distance to the other sources of its language
    (part pair, all of them) and the terms that it has more of than its language (part term, to rank top_terms)."""
    stored = Stored(df.sparkSession)
    counts = stored.keep(term_counts(df, text, lang, source), "term-counts")
    groups = counts.where("term = ''").select("lang", "source")
    terms = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
    placed, position = with_position(terms.where(F.col("docs") >= min_docs).drop("docs"), [F.col("lang"), F.col("all").desc(), F.col("term")])
    langs = placed.groupBy("lang").agg(F.min(position).alias("first"), F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    vocabulary = placed.join(langs, "lang").select("lang", "term", "all", (F.col(position) - F.col("first")).alias("id"), "kept", "lang_total")
    known = counts.where("term != ''").select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"])
    known = stored.keep(known, "known-terms")
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    long = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select("lang", "source", F.coalesce("total", long).alias("total"), F.coalesce("kept", long).alias("kept"), F.floor(number / BLOCK).alias("block"))
    groups = stored.keep(groups, "groups")
    return _pairs(known, groups).unionByName(_terms(known, groups, top_terms))


def _pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    """Distances between all sources of each language."""
    # Every group has a row in every segment of its language, also where it has no term.
    last = F.floor((F.greatest(F.col("kept"), F.lit(1)) - 1) / SEGMENT)
    cut = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
    own = known.select("lang", "source", F.floor(F.col("id") / SEGMENT).alias("segment"), (F.col("id") % SEGMENT).cast("int").alias("at"), "n")
    own = own.groupBy("lang", "source", "segment").agg(F.collect_list(F.struct("at", "n")).alias("cells"))  # SEGMENT cells at most
    none = F.array().cast("array<struct<at:int,n:bigint>>")
    rows = cut.join(own, ["lang", "source", "segment"], "left").withColumn("cells", F.coalesce("cells", none))
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    rows = rows.join(blocks, "lang")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.select("*", other.alias("other")).select(
        "lang", "source", "segment", "block", "total", "kept", F.col("cells.at").alias("at"), F.col("cells.n").alias("n"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.least(F.lit(SEGMENT).cast("long"), F.col("kept") - F.col("segment") * SEGMENT).alias("width"),
    )
    filled = rows.where("kept > 0").groupBy("lang", "segment", "i", "j").applyInPandas(_priced, "lang string, source string, item string, high long, low long")
    wide = "decimal(38,0)"
    sums = filled.groupBy("lang", "source", "item").agg(F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low"))
    sums = sums.select("lang", "source", "item", (F.col("high").cast("decimal(27,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")).cast(wide).cast("long").alias("value"))
    bare = groups.where("kept = 0").select("lang", "source")
    nothing = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return _ranked(sums.unionByName(nothing), "pair")


def _terms(known: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that a group has more of than its language, dearest first."""
    rows = known.join(groups.select("lang", "source", "total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all"), F.col("lang_total"), F.col("kept"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(rows.select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value")), "term", top)


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
