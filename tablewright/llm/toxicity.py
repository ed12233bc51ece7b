"""Toxicity by a gap-weighted subsequence kernel: a support vector machine on Nyström landmarks.

A text is a bag of sentences, a sentence a bag of words (letters only; runs of single letters are one word, so that
"i d i o t" and "i.d.i.o.t" are words). Two words are compared by their common subsequences of three letters,
each weighted by DECAY to the length it spans, so that insults with gaps or inserted signs stay close.
Labels mark documents; of a toxic document only its worst word, and words that tell the kinds apart by
themselves, are taken as proofs, found again in each round of training (multiple-instance learning). A word's score is linear in its kernel values to the
landmarks, hence linear in its subsequences: the trained machine is one weight per subsequence.

The model is fitted on a bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN documents, the ones
whose hashed ids are smallest); scoring covers every whole text.

Results by case: a null, empty or wordless text has the score of a text without evidence; words of any length are cut into
overlapping parts; without labelled documents of both kinds every score is 0; null ids and null labels take no part in
training; repeated labels of one id count once, as toxic if any is; empty tables give an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.buffers import named, slices
from tablewright.llm.store import Stored

DECAY = 0.6
SPAN = 5  # letters between the first and the last of a subsequence, at most
CODES = 64  # letters are told apart by this many codes
PART = 24  # longer words are cut into parts of this length, overlapping by half
LANDMARKS = 128
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 4000
APART = 4.0  # standard errors between a landmark's shares of toxic and of clean documents
PENALTY = 3e-4  # weight of the machine's norm beside the whole loss
LIFT = 10  # a proof's share of toxic documents is at least so many times that of clean ones
RIDGE = 0.05  # eigenvalues of the landmarks' kernel are held above it
NEAR = 0.3  # words with no kernel value above it tell the machine nothing
ROUNDS = 3
INSERTED = "xo"  # letters put into landmarks for further proofs
HARD = 128  # clean words that become landmarks after the first round
CACHE_WORDS = 1 << 20

_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]
_code = np.arange(0x110000, dtype=np.int64) * 2654435761 % 36 + 27
_code[97:123] = np.arange(1, 27)
_CODE = _code.astype(np.int32)


def words_of(text: str) -> list[str]:
    """The tokens of a text; runs of three or more single signs are one token."""
    tokens = text.lower().split()
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(single) >= 3:
        run = [single[0]]
        for i in [*single[1:], -9]:
            if i == run[-1] + 1:
                run.append(i)
            else:
                if len(run) >= 3:
                    tokens.append("".join(tokens[j] for j in run))
                run = [i]
    return tokens


def letters(token: str) -> str:
    return token if token.isalpha() else "".join([c for c in token if c.isalpha()])


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, feature, weight) of the subsequences of the words' parts, scaled to length one; the word of each part."""
    parts, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= PART:
            parts.append(w)
            owner.append(i)
        else:
            for a in range(0, len(w) - PART // 2, PART // 2):
                parts.append(w[a : a + PART])
                owner.append(i)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    width = 2 + max(map(len, parts))
    grid = np.full((len(parts), width), -1, dtype=np.int64)
    grid[:, 0] = 0  # the beginning and the end of a word are signs of their own
    grid[np.arange(len(parts)), [len(p) + 1 for p in parts]] = CODES - 1
    flat = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(p) for p in parts])
    row = np.repeat(np.arange(len(parts)), sizes)
    grid[row, 1 + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = _CODE[flat]
    keys, weights = [], []
    for a, b in _STEPS:
        if width > a + b:
            x, y, z = grid[:, : width - a - b], grid[:, a : width - b], grid[:, a + b :]
            here = np.flatnonzero((z >= 0).ravel())
            feature = (x * (CODES * CODES) + y * CODES + z).ravel()[here]
            keys.append((here // z.shape[1]) * CODES**3 + feature)
            weights.append(np.full(len(here), DECAY ** (a + b + 1)))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, weights = keys[first], np.add.reduceat(weights, first) if len(first) else weights
    part, feature = keys // CODES**3, keys % CODES**3
    norm = np.sqrt(np.bincount(part, weights**2, minlength=len(parts)))
    return part, feature, weights / norm[part], np.array(owner)


def word_scores(words: list[str], weight: np.ndarray) -> np.ndarray:
    """The machine's value of each word, without its offset: the largest of its parts."""
    out = np.full(len(words), 0.0)
    if not words:
        return out
    part, feature, value, owner = subsequences(words)
    got = np.bincount(part, value * weight[feature], minlength=len(owner))
    out[:] = -np.inf
    np.maximum.at(out, owner, got)
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of words and landmarks; of a long word the largest of its parts."""
    part, feature, value, owner = subsequences(landmarks)
    table = np.zeros((len(np.unique(feature)) + 1, len(landmarks)), dtype=np.float32)
    row = np.zeros(CODES**3, dtype=np.int64)
    known = np.unique(feature)
    row[known] = np.arange(1, len(known) + 1)
    np.add.at(table, (row[feature], owner[part]), value)
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for a in range(0, len(words), 2000):
        part, feature, value, owner = subsequences(words[a : a + 2000])
        if not len(part):
            continue
        at = row[feature]
        use = np.flatnonzero(at)
        got = np.zeros((len(owner), len(landmarks)), dtype=np.float32)
        if len(use):
            heads = np.flatnonzero(np.diff(part[use], prepend=-1))
            got[part[use][heads]] = np.add.reduceat(table[at[use]] * value[use, None].astype(np.float32), heads, axis=0)
        np.maximum.at(out, a + owner, got)
    return out


@dataclass
class Model:
    """One weight per subsequence, an offset, and the scale of the logistic curve."""

    weight: np.ndarray
    offset: float
    slope: float
    shift: float

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value + self.offset) + self.shift, -30, 30)))


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            ids, toxic, words = [], [], []
            for i, t, text in zip(named(part, "id").to_pylist(), named(part, "toxic").to_pylist(), named(part, "text").to_pylist(), strict=True):
                own = {w for w in map(letters, set(words_of(text or ""))) if len(w) >= 3}
                ids += [i] * len(own)
                toxic += [t] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(words, pa.string())], names=["id", "toxic", "word"])


def _squared_hinge(x: np.ndarray, at: np.ndarray, y: np.ndarray, c: np.ndarray, penalty: float, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps over the support vectors.

    It learns from the rows `at` of x, which are gathered a few at a time: x is the only large array.
    """
    width = x.shape[1]
    ridge = np.full(width + 1, penalty)
    ridge[-1] = 1e-6 * penalty

    def gaps(w: np.ndarray) -> np.ndarray:
        return 1 - y * ((x @ w[:-1].astype(x.dtype)).astype(np.float64)[at] + w[-1])

    def loss(w: np.ndarray) -> float:
        return float((ridge * w * w).sum() + (c * np.maximum(0, gaps(w)) ** 2).sum())

    w = np.zeros(width + 1)
    for _ in range(steps):
        gap = gaps(w)
        slope, curve = ridge * w, np.diag(ridge)
        rows = np.flatnonzero(gap > 0)
        for a in range(0, len(rows), 2048):
            some = np.ones((len(rows[a : a + 2048]), width + 1))
            some[:, :-1] = x[at[rows[a : a + 2048]]]
            pull = c[rows[a : a + 2048]]
            slope = slope - some.T @ (pull * y[rows[a : a + 2048]] * gap[rows[a : a + 2048]])
            curve = curve + (some * pull[:, None]).T @ some
        move = np.linalg.solve(curve, slope)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _logistic(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, both kinds weighing the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * value + b, -30, 30)))
        g = np.array([(weight * (p - y) * value).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        s = weight * p * (1 - p) + 1e-9
        h = np.array([[(s * value * value).sum() + 1e-3, (s * value).sum()], [(s * value).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on documents (id, text) and labels (id, toxic)."""
    spark, stored = docs.sparkSession, Stored(docs.sparkSession)
    none = Model(np.zeros(CODES**3), 0.0, 0.0, -30.0)
    marked = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = F.xxhash64("id")
    sample = None
    for kind, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        some = marked.where(F.col("toxic") == kind).orderBy(by_hash, "id").limit(n)
        sample = some if sample is None else sample.unionByName(some)
    sample = stored.keep(sample, "sample")
    rows = docs.join(F.broadcast(sample), "id")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    words = stored.keep(rows.select("id", "toxic", "text").mapInArrow(_sample_words, "id long, toxic int, word string"), "sample-words")
    totals = {r["toxic"]: r["n"] for r in words.groupBy("toxic").agg(F.countDistinct("id").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        stored.drop()
        return none
    stats = stored.keep(words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "word-stats")
    share_bad, share_good = F.col("bad") / totals[1], F.col("good") / totals[0]
    pooled = (F.col("bad") + F.col("good")) / (totals[0] + totals[1])
    apart = (share_bad - share_good) / (F.sqrt(pooled * (1 - pooled) * (1 / totals[0] + 1 / totals[1])) + 1e-12)
    top = stats.where("bad >= 2").withColumn("apart", apart).where(F.col("apart") >= APART).orderBy(F.desc("apart"), "word").limit(LANDMARKS).collect()
    if not top:
        stored.drop()
        return none
    landmarks = [r["word"] for r in top]

    def near(batches):
        for batch in batches:
            own = named(batch, "word").to_pylist()
            values = kernel(own, landmarks)
            keep = np.flatnonzero(values.max(axis=1) >= NEAR) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep))], names=["word"])

    close = stats.select("word").mapInArrow(near, "word string")
    bags: dict[int, tuple[int, list[str]]] = {}
    for r in words.join(close, "word").select("id", "toxic", "word").distinct().orderBy("id").toLocalIterator():  # of the sample
        bags.setdefault(r["id"], (r["toxic"], []))[1].append(sys.intern(r["word"]))
    stored.drop()
    return _train(landmarks, list(bags.values()), totals)


def _border(value: np.ndarray, toxic: np.ndarray) -> float:
    """Where the fewest documents lie on the wrong side; among equal places the middle of the widest gap."""
    order = np.argsort(value, kind="stable")
    value, toxic = value[order], toxic[order]
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + (toxic == 0).sum() - np.concatenate([[0], np.cumsum(toxic == 0)])
    gap = np.diff(value)
    inner = wrong[1:-1].astype(float)
    inner[gap <= 1e-9] = np.inf
    if not len(inner) or not np.isfinite(inner).any():
        return float(value[-1]) + 1.0
    best = np.flatnonzero(inner == inner.min())
    i = best[np.argmax(gap[best])]
    return float(value[i] + value[i + 1]) / 2


def _train(landmarks: list[str], bags: list[tuple[int, list[str]]], totals: dict[int, int]) -> Model:
    vocabulary = sorted({w for _, words in bags for w in words})
    at = {w: i for i, w in enumerate(vocabulary)}
    bad_count, good_count = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for toxic, words in bags:
        for w in words:
            (bad_count if toxic else good_count)[at[w]] += 1
    bad = [np.array([at[w] for w in words]) for toxic, words in bags if toxic]
    if not bad:
        return Model(np.zeros(CODES**3), 0.0, 0.0, -30.0)
    pooled = (bad_count + good_count) / (totals[0] + totals[1])
    spread = np.sqrt(pooled * (1 - pooled) * (1 / totals[0] + 1 / totals[1])) + 1e-12
    apart = (bad_count / totals[1] - good_count / totals[0]) / spread
    current, certain = apart.copy(), apart >= APART
    negative = np.flatnonzero(good_count)
    # the same proofs with a letter inserted are proofs as well
    inserted = [(w[:k] + mark + w[k:], bad_count[at[w]] / len(w)) for w in landmarks if w in at for k in range(1, len(w)) for mark in INSERTED]
    for turn in range(ROUNDS):
        if turn == 1:
            # clean words that come closest to the border are landmarks as well
            hard = negative[np.argsort(-(current[negative] + 1), kind="stable")][:HARD]
            landmarks = landmarks + [w for w in (vocabulary[i] for i in hard) if w not in set(landmarks)]
        if turn <= 1:
            gram = kernel(landmarks, landmarks).astype(float)
            value, vector = np.linalg.eigh((gram + gram.T) / 2)
            root = vector / np.sqrt(np.maximum(value, RIDGE)) @ vector.T
            # the vocabulary, the inserted proofs, and a word unlike all landmarks
            x = np.zeros((len(vocabulary) + len(inserted) + 1, len(landmarks)), dtype=np.float32)
            everything = vocabulary + [w for w, _ in inserted]
            for a in range(0, len(everything), 8192):
                x[a : a + len(everything[a : a + 8192])] = kernel(everything[a : a + 8192], landmarks) @ root.astype(np.float32)
        # of each toxic document the worst word, and all that tell toxic from clean documents by themselves
        witness = np.concatenate([own[certain[own] | (current[own] == current[own].max())] for own in bad])
        proof, times = np.unique(witness, return_counts=True)
        # a proof that clean documents share is none
        fair = LIFT * good_count[proof] / totals[0] < bad_count[proof] / totals[1]
        proof, times = proof[fair], times[fair]
        rows = np.concatenate([proof, len(vocabulary) + np.arange(len(inserted)), negative, [len(x) - 1]]).astype(np.int64)
        y = np.concatenate([np.ones(len(proof) + len(inserted)), -np.ones(len(negative) + 1)])
        c = np.concatenate([times, [n for _, n in inserted], good_count[negative], [totals[0]]])
        c[y > 0] *= c[y < 0].sum() / max(1e-9, c[y > 0].sum())
        w, offset = _squared_hinge(x, rows, y, c, PENALTY * c.sum())
        current = (x @ w.astype(np.float32))[: len(vocabulary)].astype(float) + offset
    part, feature, weight, owner = subsequences(landmarks)
    linear = np.bincount(feature, weight * (root @ w)[owner[part]], minlength=CODES**3)
    highest = np.array([max(0.0, (current[[at[v] for v in words]] - offset).max()) if words else 0.0 for _, words in bags])
    kinds = np.array([float(toxic) for toxic, _ in bags])
    idle = {k: n - int((kinds == k).sum()) for k, n in totals.items()}  # documents without a near word
    value = np.concatenate([highest, np.zeros(idle[0] + idle[1])])
    kinds = np.concatenate([kinds, np.zeros(idle[0]), np.ones(idle[1])])
    border = _border(value, kinds)
    slope, _ = _logistic(value - border, kinds)
    return Model(linear.astype(np.float32), -border, slope, 0.0)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of df with score (0 to 1): how likely the whole text is toxic."""
    if "score" in {c.lower() for c in df.columns}:
        raise ValueError("column score exists already")

    def rows(batches):
        known: dict[str, float] = {}
        for batch in batches:
            for part in slices(batch, text):
                tokens = [set(words_of(t or "")) for t in named(part, text).to_pylist()]
                new = list({w for own in tokens for w in own if w not in known})
                if len(known) + len(new) > CACHE_WORDS:
                    known = {}
                    new = list(set().union(*tokens))
                for a in range(0, len(new), 4000):
                    some = new[a : a + 4000]
                    bare = [letters(w) for w in some]
                    values = word_scores([w if len(w) >= 3 else "" for w in bare], model.weight)
                    known.update(zip(some, [v if len(w) >= 3 else 0.0 for v, w in zip(values.tolist(), bare, strict=True)], strict=True))
                get = known.__getitem__
                best = np.array([max(map(get, own), default=0.0) for own in tokens])
                scores = model.probability(np.maximum(best, 0.0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, "score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(rows, f"{fields}, score double")
