"""Personal data in texts by weak supervision, in DataFrame functions alone.

Every candidate span gets four votes (1 for, -1 against, 0 none): how strict a pattern it fits, what gazetteers
of endings, prefixes and codes say, which words stand before it, and what its shape looks like. Candidates are
counted by kind and votes over the whole table; expectation-maximisation on these counts (their number is fixed
by kinds and votes, not by rows) estimates how reliable each labeler is and how likely each pattern
of votes is personal. Its posteriors train the final span classifier, a logistic regression over votes and
kind. Spans that fit a base pattern and its check always stay; other candidates (credentials, telephone numbers
without a country code) are added where the classifier says so and no base span is in the way.

Offsets are code points, ends exclusive; they come from the lengths of matches and of the text between them.
Quantifiers are possessive and starts are anchored, so that the time is linear in the text's length.

Results by case: a null or empty text has no spans; repeated rows give repeated results; a null id is kept; other
columns pass through, clashing names raise; without candidates nothing is learned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.store import Stored

# Base patterns by kind, in the order of the contract, made linear without changing what they match:
# a start inside a run that has been tried from its first character can't match either, except right after a match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further candidates.
ADDED = {
    "key": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}|(?i:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\x22']?[0-9A-Za-z+/_.-]{6,}+|[0-9a-f]{24,64})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Text that a pattern can't match without.
NEEDED = {"email": "@", "phone": "+", "ip": "."}
KINDS = [*BASE, "key"]
# What the gazetteer and context labelers know.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ch|at|nl|be|ca|au|in|jp|cn|ru|br)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|65|62)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
    "key": r"^(?:AKIA|gh[pousr]_|sk-|(?i:password|passwd|secret|token|api))",
}
CONTEXT = {
    "email": r"(?:mail|contact|write|reach|from|kontakt|courriel|correo)\W*$",
    "ip": r"(?:ip|host|server|address|login|client|adresse|direcci)\W*$",
    "card": r"(?:card|credit|visa|mastercard|amex|karte|carte|tarjeta)\W*$",
    "phone": r"(?:call|phone|tel|mobile|fax|telefon|t.l.phone|tel.fono)\W*$",
    "key": r"(?:password|secret|token|key|credential|login|export)\W*$",
}
SHAPE = {
    "email": r"^[A-Za-z][A-Za-z0-9._-]+@",
    "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})$",
    "phone": r"[\x20().-]",
    "key": r"(?=.*[0-9])(?=.*[A-Za-z])",
}
VOTES = ["strict", "gazetteer", "context", "shape"]
CONTEXT_CHARS = 24
# Matches placed at a time.
BLOCK = 64
# Starting guesses of expectation-maximisation and the strength with which they hold on, in candidates.
PRIOR, ACCURACY, STRENGTH = 0.6, 0.8, 4.0
STEPS = 50

SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string, base: boolean, strict: int, gazetteer: int, context: int, shape: int>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    signs = F.filter(F.split(F.reverse(_digits(x)), ""), lambda c: c != "")
    doubled = F.transform(signs, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """The check that a match of a base pattern has to pass."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.concat(F.lit("0"), F.right(bare(p), F.lit(3))).cast("int") <= 255))
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, otherwise: int) -> Column:
    return F.when(yes, F.lit(1)).otherwise(F.lit(otherwise))


def _found(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """The candidates of one pattern, in order."""

    def placed(matches: Column) -> Column:
        # one element, so that the text is split once
        return F.get(F.transform(F.array(F.split(text, pattern, -1)), lambda between: located(matches, between)), F.lit(0))

    def located(matches: Column, between: Column) -> Column:

        def step(state: Column, i: Column) -> Column:
            gap, match = F.get(between, i), F.get(matches, i)
            start = state["at"] + F.length(gap)
            end = start + F.length(match)
            before = F.lower(F.right(gap, F.lit(CONTEXT_CHARS)))
            strict = F.lit(1) if base else _vote(match.rlike("^(?:AKIA|gh._|sk-)") if kind == "key" else F.lit(False), 0)
            span = F.struct(
                start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("long").alias("end"), F.lit(kind).alias("kind"),
                F.lit(base).alias("base"), strict.alias("strict"), _vote(match.rlike(GAZETTEER[kind]), -1).alias("gazetteer"),
                _vote(before.rlike(CONTEXT[kind]), 0).alias("context"), _vote(match.rlike(SHAPE[kind]), -1).alias("shape"),
            )
            good = _valid(kind, match) if base else F.lit(True)
            return F.struct(end.cast("int").alias("at"), F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        # in blocks, so that a text with very many matches isn't copied once for each of them
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        last = F.size(matches) - 1
        blocks = F.transform(
            F.sequence(F.lit(0), last, F.lit(BLOCK)), lambda i: F.aggregate(F.sequence(i, F.least(i + BLOCK - 1, last)), start, step)
        )
        return F.get(F.transform(F.array(blocks), joined), F.lit(0))

    def joined(blocks: Column) -> Column:
        def shifted(block: Column, j: Column) -> Column:
            offset = F.aggregate(F.slice(blocks, 1, j), F.lit(0), lambda a, b: a + b["at"])
            return F.transform(block["spans"], lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset))

        return F.flatten(F.transform(blocks, shifted))

    none = F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if base and kind in NEEDED:
        matches = F.when(F.contains(text, F.lit(NEEDED[kind])), matches).otherwise(F.array().cast("array<string>"))
    # one element, so that the matches are made once
    return F.get(F.transform(F.array(matches), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none)), F.lit(0))


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of df with candidates: spans with their votes, by start, then kind."""
    if "candidates" in {c.lower() for c in df.columns}:
        raise ValueError("column candidates exists already")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(*[_found(whole, k, p, True) for k, p in BASE.items()])
    added = F.concat(*[_found(whole, k, p, False) for k, p in ADDED.items()])
    return df.withColumn("candidates", F.array_sort(F.concat(base, added)))


def _reliabilities(counts: dict[tuple[int, ...], float]) -> dict[tuple[int, ...], float]:
    """How likely each pattern of votes is personal: a two-class mixture of independent labelers."""
    prior = PRIOR
    total = sum(counts.values())
    table = [{c: {v: ((ACCURACY if (v > 0) == (c == 1) else 1 - ACCURACY) if v else 0.5) for v in (-1, 0, 1)} for c in (0, 1)} for _ in VOTES]
    start = [{c: dict(t[c]) for c in t} for t in table]
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(STEPS):
        for votes in counts:
            yes = prior * math.prod(t[1][v] for t, v in zip(table, votes, strict=True))
            no = (1 - prior) * math.prod(t[0][v] for t, v in zip(table, votes, strict=True))
            posterior[votes] = yes / (yes + no)
        prior = (sum(n * posterior[v] for v, n in counts.items()) + STRENGTH * PRIOR) / (total + STRENGTH)
        for j, t in enumerate(table):
            for c in (0, 1):
                mass = {v: STRENGTH * start[j][c][v] for v in (-1, 0, 1)}
                for votes, n in counts.items():
                    mass[votes[j]] += n * (posterior[votes] if c else 1 - posterior[votes])
                whole = sum(mass.values())
                t[c] = {v: max(1e-6, x / whole) for v, x in mass.items()}
    return posterior


def fit(candidates: DataFrame) -> dict[tuple[str, ...], float]:
    """From a table with candidates: the classifier's probability for each kind and pattern of votes."""
    spans = candidates.select(F.explode("candidates").alias("s")).select("s.kind", *[f"s.{v}" for v in VOTES])
    rows = spans.groupBy("kind", *VOTES).count().collect()  # at most kinds times patterns of votes
    soft: list[tuple[list[float], float, float]] = []
    for kind in KINDS:
        counts = {tuple(r[v] for v in VOTES): float(r["count"]) for r in rows if r["kind"] == kind}
        for votes, p in _reliabilities(counts).items() if counts else ():
            soft.append((_features(kind, votes), p, counts[votes]))
    weights = _logistic(soft)
    every = product(KINDS, *[(-1, 0, 1)] * len(VOTES))
    return {(k, *v): 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, _features(k, v), strict=True)))))) for k, *v in every}


def _features(kind: str, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], *[float(v == s) for v in votes for s in (-1, 1)]]


def _logistic(rows: list[tuple[list[float], float, float]], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Logistic regression on soft labels, weighted by the logarithm of the counts."""
    weights = [0.0] * len(_features(KINDS[0], (0,) * len(VOTES)))
    total = sum(math.log1p(n) for _, _, n in rows) or 1.0
    for _ in range(steps):
        slope = [1e-3 * w for w in weights]
        for x, p, n in rows:
            gap = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True)))))) - p
            for j, a in enumerate(x):
                slope[j] += math.log1p(n) / total * gap * a
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def decide(df: DataFrame, model: dict[tuple[str, ...], float]) -> DataFrame:
    """df with candidates replaced by spans: base spans, and other candidates that the classifier accepts."""
    yes = sorted(":".join(map(str, k)) for k, p in model.items() if p >= 0.5)
    accepted = F.array(*[F.lit(x) for x in yes]) if yes else F.array().cast("array<string>")
    base = F.filter("candidates", lambda s: s["base"])

    def keep(s: Column) -> Column:
        free = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return s["base"] | (F.array_contains(accepted, F.concat_ws(":", s["kind"], *[s[v].cast("string") for v in VOTES])) & free)

    return df.withColumn("spans", F.filter("candidates", keep)).drop("candidates")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def find(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    lasting = Stored(df.sparkSession)
    candidates = lasting.keep(annotate(df.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text").drop("text"), "candidates")
    spans = decide(candidates, fit(candidates))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of df, each span in the text replaced by its kind in brackets; a null text stays null."""
    lasting = Stored(df.sparkSession)
    annotated = lasting.keep(annotate(df, text), "annotated")
    spans = decide(annotated, fit(annotated))
    return _masked(spans, text)


# Code points in a chunk of a text that is cut at many places.
CHUNK = 1024


def _masked(rows: DataFrame, text: str) -> DataFrame:
    """Cut the text at its spans and join what is left with the kinds' names, in time linear in the text and its spans.

    The text is divided into chunks once, so that no cut has to walk from the beginning; spans are gone through in blocks and
    the pieces joined once, so that nothing that grows is copied for every span. A span that begins inside an earlier
    one is part of it.
    """
    chunks, cuts = "__chunks", "__cuts"
    none = F.array().cast("array<struct<at:bigint,start:bigint,kind:string>>")

    def step(state: Column, s: Column) -> Column:
        piece = F.struct(state["at"].alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
        more = F.when(s["start"] >= state["at"], F.concat(state["pieces"], F.array(piece))).otherwise(state["pieces"])
        return F.struct(more.alias("pieces"), F.greatest(state["at"], s["end"]).alias("at"))

    def block(state: Column, first: Column) -> Column:
        start = F.struct(none.alias("pieces"), state["at"].alias("at"))
        inner = F.aggregate(F.slice("spans", first, F.lit(BLOCK)), start, step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(F.concat(state["done"], F.array(x["pieces"])).alias("done"), x["at"].alias("at"))), F.lit(0))

    begin = F.struct(F.array().cast("array<array<struct<at:bigint,start:bigint,kind:string>>>").alias("done"), F.lit(0).cast("long").alias("at"))
    found = F.aggregate(F.sequence(F.lit(1), F.size("spans"), F.lit(BLOCK)), begin, block)

    def between(start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        inside, rest = (start % CHUNK).cast("int"), (end % CHUNK).cast("int")
        head, tail = F.coalesce(F.get(chunks, first), F.lit("")), F.coalesce(F.get(chunks, last), F.lit(""))
        whole = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(F.substring(head, inside + 1, F.lit(CHUNK)), whole, F.substring(tail, F.lit(1), rest))
        return F.when(first == last, F.substring(head, inside + 1, rest - inside)).otherwise(across)

    some = F.size("spans") > 0
    cut = rows.withColumn(chunks, F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))).withColumn(cuts, F.when(some, found))
    pieces = F.transform(F.flatten(F.col(cuts)["done"]), lambda x: F.concat(between(x["at"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    masked = F.concat(F.array_join(pieces, ""), between(F.col(cuts)["at"], F.length(text).cast("long")))
    return cut.withColumn(text, F.when(some, masked).otherwise(F.col(text))).drop("spans", chunks, cuts)
