"""Quality rules with thresholds learned per language and source, in DataFrame functions alone.

Every text is measured once, in its own row. The measures of all documents go into quantile sketches, one for each
group of language and source and each measure: a histogram of whole numbers whose bins keep BITS leading binary
digits, so that a bin is at most 2^(1 - BITS) of its value wide. Such sketches merge by adding counts, in any order and
with the same result, and their size is bounded by the bins, not by the rows. A group with fewer than MIN_ROWS
documents takes the merged sketch of its language, a small language that of all documents.

From a sketch come the quartile and the median; a measure is out of line if it lies further than REACH widths from the
median, where the width is the distance from quartile to median, or the measure's unit if that is more. The half of
the distribution below the median decides, so that junk in up to half of a group doesn't move the threshold much.

Results by case: a null or empty text has no words and fails the base rules; null languages and sources form groups of
their own; tied values fall into the same bin; repeated rows count as often as they occur and get the same verdict;
other columns pass through, clashing names raise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.store import Stored

# White space, symbols and the base rules of the contract.
SPACE, SPACE_SET = "\t\n\x0b\x0c\r ", r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
# Sketch: leading binary digits that a bin keeps; rows that a group needs to have thresholds of its own.
BITS = 7
MIN_ROWS = 100
# Allowed distance from the median, in widths.
REACH = 8
# A group above this share of the rows meets its thresholds by broadcast; fewer than 1 / share can be.
HOT_SHARE = 1e-3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Measures in ten thousandths: numerator, denominator, what is added to it so that short texts don't jump, least width, whether a low value counts.
MEASURES = {
    "mean_word": ("word_chars", "n_words", 0, 5_000, True),
    "symbols": ("n_symbols", "n_words", 20, 100, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10, 500, False),
    "repeats": ("n_repeat_words", "n_words", 20, 200, False),
    "capitals": ("n_capitals", "word_chars", 100, 100, False),
}
_OWN = ["n_lines", "n_capitals"]


def _high(key: Column, bits: Column) -> Column:
    return F.call_function("shiftright", key, bits)


def _paired(left: Column, right: Column, by: int) -> Column:
    """Hashes of each element of one array with the element of the other that stands `by` places on."""
    return F.zip_with(left, F.slice(right, F.lit(by + 1), F.greatest(F.size(right), F.lit(0))), lambda a, b: F.xxhash64(a, b))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with its counts. Windows are compared within their row, nothing is shuffled."""
    new = [*COUNTS, *_OWN]
    if clash := {c.lower() for c in df.columns} & set(new):
        raise ValueError(f"columns {sorted(clash)} exist already")
    kept = [c for c in df.columns if c != text]
    t, w, h, k, e, p = (f"__{x}" for x in ("text", "words", "hashes", "keys", "exact", "places"))
    counts = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    rows = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    bare = F.btrim(F.col(t), F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_SET}]+"))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    rows = rows.select(*kept, t, words.alias(w), lines.alias(e))
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")),
        "n_capitals": F.regexp_count(t, F.lit("[A-Z]")),
        "n_lines": F.size(e),
        "n_dup_lines": F.size(e) - F.size(F.array_distinct(e)),
    }
    rows = rows.select(*kept, w, *[c.cast("long").alias(name) for name, c in found.items()], F.transform(w, lambda x: F.xxhash64(x)).alias(h))
    # A hash of each window of five, from pairs, pairs of pairs, and one word more.
    rows = rows.select(*kept, *counts, w, h, _paired(F.col(h), F.col(h), 1).alias(k))
    rows = rows.select(*kept, *counts, w, h, _paired(F.col(k), F.col(k), 2).alias(k))
    windows = F.slice(_paired(F.col(k), F.col(h), 4), F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0)))
    rows = rows.select(*kept, *counts, w, windows.alias(k))
    # In a row with equal hashes each one keeps its high bits and takes the window's place below them, so that plain numbers are sorted.
    bits = F.length(F.bin(F.col("n_words")))
    none = F.array().cast("array<bigint>")
    numbered = F.transform(F.col(k), lambda x, i: F.call_function("shiftleft", _high(x, bits), bits).bitwiseOR(i.cast("long")))
    rows = rows.select(*kept, *counts, w, F.when(F.size(F.array_distinct(k)) == F.size(k), none).otherwise(numbered).alias(k))
    rows = rows.select(*kept, *counts, w, F.sort_array(k).alias(k))
    same = lambda x, j: F.coalesce(_high(x, bits) == _high(F.get(F.col(k), j), bits), F.lit(False))
    rows = rows.select(*kept, *counts, w, F.filter(F.col(k), lambda x, j: same(x, j - 1) | same(x, j + 1)).alias(k))
    # Hashes only propose; the words themselves decide.
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    shown = F.transform(F.col(k), lambda x: F.struct(
        F.array_join(F.slice(F.col(w), x.bitwiseAND(mask).cast("int") + 1, F.lit(WINDOW)), " ").alias("words"), x.bitwiseAND(mask).alias("at")))
    rows = rows.select(*kept, *counts, F.sort_array(shown).alias(e))
    equal = lambda x, j: F.coalesce(x["words"] == F.get(F.col(e), j)["words"], F.lit(False))
    true = F.transform(F.filter(F.col(e), lambda x, j: equal(x, j - 1) | equal(x, j + 1)), lambda x: x["at"])
    rows = rows.select(*kept, *counts, F.sort_array(true).alias(p))
    whole = F.lit(WINDOW).cast("long")
    covered = F.transform(F.col(p), lambda x, j: F.least(whole, F.coalesce(F.get(F.col(p), j + 1) - x, whole)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select(*kept, *counts, total.alias("n_repeat_words"))


def _value(name: str) -> Column:
    """The measure as a whole number; 0 without a denominator."""
    top, below, more, _, _ = MEASURES[name]
    return F.coalesce(F.call_function("div", F.col(top) * 10_000, F.nullif(F.col(below) + more, F.lit(0).cast("long"))), F.lit(0).cast("long"))


def _bin(value: Column) -> Column:
    """The lowest value of the sketch's bin."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", _high(value, shift), shift)


def sketches(measured: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row for each group, measure and filled bin: its count. Each task adds up its own rows first."""
    cells = F.array(*[F.struct(F.lit(name).alias("measure"), _bin(_value(name)).alias("bin")) for name in MEASURES])
    return measured.select(*groups, F.inline(cells)).groupBy(*groups, "measure", "bin").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, first quartile and median for each key; a key has as many rows as there are measures and bins."""
    bins = F.sort_array(F.collect_list(F.struct("bin", "n")))
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n")).groupBy(*keys, "measure").agg(F.sum("n").alias("rows"), bins.alias("bins"))

    def at(quarters: int) -> Column:
        reached = F.aggregate(
            "bins", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("found")),
            lambda s, b: F.struct((s["sum"] + b["n"]).alias("sum"), F.coalesce(s["found"], F.when(4 * (s["sum"] + b["n"]) >= quarters * F.col("rows"), b["bin"])).alias("found")),
        )
        return reached["found"]

    return merged.select(*keys, "measure", "rows", at(1).alias("quartile"), at(2).alias("median"))


def thresholds(sketch: DataFrame, groups: Sequence[str], min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """One row for each group: its rows and the lowest and highest allowed value of every measure.

    A group that is too small takes its parent's sketch: that of the first column, then that of all rows.
    """
    parts = [_quantiles(sketch, groups[:i]) for i in range(len(groups), -1, -1)]
    found = parts[0].select(*groups, "measure", *[F.col(c).alias(f"{c}0") for c in ("rows", "quartile", "median")])
    for level, part in enumerate(parts[1:], 1):
        keys = groups[: len(groups) - level]
        named = part.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("measure").alias("k_measure"), *[F.col(c).alias(f"{c}{level}") for c in ("rows", "quartile", "median")])
        on = F.col("measure") == F.col("k_measure")
        for key in keys:
            on &= F.col(key).eqNullSafe(F.col(f"k_{key}"))
        found = found.join(named, on, "left").drop("k_measure", *[f"k_{k}" for k in keys])

    def chosen(name: str) -> Column:
        column = F.col(f"{name}{len(groups)}")
        for level in range(len(groups) - 1, -1, -1):
            column = F.when(F.col(f"rows{level}") >= min_rows, F.col(f"{name}{level}")).otherwise(column)
        return column

    least = F.create_map(*[x for name, m in MEASURES.items() for x in (F.lit(name), F.lit(m[3]).cast("long"))])
    width = F.greatest(F.col("median") - F.col("quartile"), F.try_element_at(least, F.col("measure")))
    limits = found.select(*groups, "measure", F.col("rows0").alias("rows"), chosen("quartile").alias("quartile"), chosen("median").alias("median"))
    limits = limits.select(*groups, "measure", "rows", (F.col("median") - reach * width).alias("low"), (F.col("median") + reach * width).alias("high"))
    picked = [F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}") for name in MEASURES for side in ("low", "high")]
    return limits.groupBy(*groups).agg(F.max("rows").alias("group_rows"), *picked)


def judge(df: DataFrame, text: str = "text", groups: Sequence[str] = ("lang", "source"), min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """All columns but the text, with the counts, base_failed and kept.

    The measured rows are written once. Groups that hold much of the table meet their thresholds by broadcast, so that
    no task gets a hot group; rows of the others are dealt out by group.
    """
    if clash := {c.lower() for c in df.columns} & {"base_failed", "kept", "group_rows", *[f"{m}_{s}" for m in MEASURES for s in ("low", "high")]}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    stored, groups = Stored(df.sparkSession), list(groups)
    measured = stored.keep(measure(df, text), "measured")
    limits = stored.keep(thresholds(stored.keep(sketches(measured, groups), "sketches"), groups, min_rows, reach), "thresholds")
    total = limits.agg(F.sum("group_rows")).head()[0] or 0
    bound = F.lit(total * HOT_SHARE)
    hot, rare = limits.where(F.col("group_rows") > bound), limits.where(F.col("group_rows") <= bound)

    def met(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
        on = F.lit(True)
        named = side.drop("group_rows").select(*[F.col(g).alias(f"k_{g}") for g in groups], *[c for c in side.columns if c not in (*groups, "group_rows")])
        for g in groups:
            on &= F.col(g).eqNullSafe(F.col(f"k_{g}"))
        return rows.join(named, on, how)

    known = met(measured, F.broadcast(hot.withColumn("is_hot", F.lit(True))), "left")
    limited = [f"{m}_{s}" for m in MEASURES for s in ("low", "high")]
    rest = known.where(F.col("is_hot").isNull()).select(*measured.columns)
    done = known.where(F.col("is_hot")).select(*measured.columns, *limited)
    joined = done.unionByName(met(rest, rare, "inner").select(*measured.columns, *limited))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fine = F.lit(True)
    for name, (*_, low_counts) in MEASURES.items():
        fine &= _value(name) <= F.col(f"{name}_high")
        if low_counts:
            fine &= _value(name) >= F.col(f"{name}_low")
    return joined.select(*[c for c in measured.columns if c not in _OWN], base.alias("base_failed"), (~base & fine).alias("kept"))
