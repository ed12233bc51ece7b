"""From buckets of possible duplicates to components of confirmed ones, without pairs as rows.

A bucket's key carries, in its lowest bits, the place in the signature that made it (placed()), so that
of several buckets that two members share one is the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.buffers import named, slices, utf8
from tablewright.llm.hashing import shared
from tablewright.llm.store import Stored, components

# Pivots of a bucket that its other members are held against.
PIVOT_ROUNDS = 2
# Members and bytes of text in a block of a bucket; a task compares two blocks at once.
BLOCK, BLOCK_BYTES = 2048, 1 << 23
# Members of a bucket up to which its pairs are compared together with those of other buckets.
FEW = 8
# Bits of the bitmaps that bound an intersection from above, for each shingle and at most.
BITS, MAX_BITS = 8, 1 << 13
PLACES = 64

Sets = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]
Keys = Callable[[list[bytes]], np.ndarray]


def placed(keys: np.ndarray) -> np.ndarray:
    """Keys (rows x places) with their place in the lowest bits, as signed numbers."""
    return (keys & ~np.uint64(PLACES - 1) | np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in the order of their keys those whose key more than one id has."""
    last: pa.RecordBatch | None = None
    given = False  # whether `last`, an entry of the key that may go on, has been given already
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        key, ids = named(batch, "key").to_numpy(), named(batch, "id").to_numpy()
        heads = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        several = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
        use = np.repeat(several, np.diff(heads, append=len(key)))
        use[0] &= not given
        given = bool(several[-1]) or (given and len(heads) == 1)
        last = batch.slice(batch.num_rows - 1)
        yield batch.filter(pa.array(use))


def shared_buckets(entries: DataFrame) -> DataFrame:
    """Of entries (key, id, ...), those whose key more than one id has; of buckets with the same members the first.

    Entries may come several times. Members are told apart by four sums of 32-bit hashes, which long integers hold for
    2^31 entries.
    """
    entries = entries.where("key is not null").repartition("key").sortWithinPartitions("key")
    # few entries are left; filtered here, both uses of them read the same, and what distinct() shuffles is made once
    entries = entries.mapInArrow(_met, entries.schema).where("key is not null").distinct()
    hashed = [F.xxhash64(*[c for c in entries.columns if c != "key"], F.lit(i)) for i in range(2)]
    halves = [half for h in hashed for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = [F.sum(x).alias(f"h{i}") for i, x in enumerate(halves)]
    ends = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), *sums)
    first = ends.groupBy("lo", "hi", *[f"h{i}" for i in range(len(halves))]).agg(F.min_by("key", F.col("key").bitwiseAND(PLACES - 1)).alias("key")).select("key")
    return entries.join(first.hint("shuffle_hash"), "key")


def resolve(stored: Stored, buckets: DataFrame, percent: int, members: DataFrame, sets: Sets, keys: Keys, small: int = 1) -> DataFrame:
    """(node, component) of the members of buckets (key, id, n) that links join.

    members: (id, text, sig) of every id in a bucket. sets() makes the shingle sets of texts, keys() the bucket keys of
    signatures in the order of their places. n is the size of a member's set, or the same for all; sizes too far apart
    for `percent` are never paired.

    In each of two rounds a member meets one pivot of its buckets, with `small` above 1 in one round two pivots of its
    buckets of more than `small` members; links found make components, and buckets of a
    single component are done. What is left is dealt into blocks, and pairs of blocks into tasks. A task compares
    members of different components on their full sets, a pair only in the first bucket that it shares; a pair is
    passed over if even an upper bound of its intersection, from bitmaps, is too small. Tasks return links that span what they
    have found, so that nothing grows with the pairs but the comparing itself.
    """
    fit = f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)"
    found: list[DataFrame] = []
    labels: DataFrame | None = None

    def follow(links: DataFrame) -> DataFrame:
        found.append(stored.keep(links, "links"))
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return stored.keep(components(every), "components")

    def undecided(buckets: DataFrame) -> DataFrame:
        if labels is None:
            return buckets.withColumn("label", F.col("id"))
        own = labels.select(F.col("node").alias("id"), "component")
        with_label = buckets.join(own, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        with_label = stored.keep(with_label, "labelled")
        open_keys = with_label.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
        return stored.keep(with_label.join(open_keys, "key"), "undecided")

    # every bucket has two members at least
    large = buckets
    if small > 1:
        keys_of = buckets.groupBy("key").agg(F.count("*").alias("members")).where(f"members > {small}").select("key")
        large = stored.keep(buckets.join(keys_of, "key", "left_semi"), "large")
    # where few buckets have pivots, a round costs more than what the links of the one before would spare it
    pivots_of = range(PIVOT_ROUNDS)
    for round_of in [[i] for i in pivots_of] if small == 1 else [[*pivots_of]]:
        now = undecided(large)
        if not round_of or now.isEmpty():
            break
        orders = [
            F.struct(
                (F.col("id") if i == 0 else F.xxhash64("id", F.lit(i))).alias("order"),
                F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("label").alias("pivot_label"), F.lit(i).alias("which"),
            )
            for i in round_of
        ]
        chosen = now.groupBy("key").agg(*[F.min(x).alias(f"p{i}") for i, x in zip(round_of, orders, strict=True)])
        chosen = chosen.select("key", F.explode(F.array(*[f"p{i}" for i in round_of])).alias("p"))
        pivots = chosen.select("key", "p.pivot", "p.pivot_n", "p.pivot_label", "p.which")
        met = now.join(pivots, "key").where("label != pivot_label").where(fit)
        pairs = met.groupBy("id", "which").agg(F.min("pivot").alias("pivot")).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        labels = follow(with_both(pairs, members, "text").mapInArrow(_confirmed(percent, sets), "a long, b long"))
    rest = undecided(buckets)
    if labels is None or not rest.isEmpty():
        labels = follow(_dealt(rest, members).mapInArrow(_compared(percent, sets, keys), "a long, b long").distinct())
    return labels


def _dealt(rest: DataFrame, members: DataFrame) -> DataFrame:
    """Entries with their texts, in the order of (key, low, high): every member with each block of its bucket."""
    rest = rest.join(members.withColumn("bytes", F.octet_length("text")).select("id", "bytes"), "id")
    sizes = rest.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    dealt = rest.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "label")
    return dealt.hint("shuffle_hash").join(members.select("id", "text", "sig"), "id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id")


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with a column of the table (id, column) for either side: column_a, column_b."""
    side = {x: table.select(F.col("id").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = shared(x, y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int, sets: Sets):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                left, right = sets(*utf8(named(part, "text_a"))), sets(*utf8(named(part, "text_b")))
                yes = [linked(x, y, percent) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([named(part, "a"), named(part, "b")], names=["a", "b"]).filter(pa.array(yes))

    return rows


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bitmap (words of 64 bits) for each set of hashes: each hash sets a bit."""
    most = max(len(s) for s in sets)
    bits = min(MAX_BITS, max(64, 1 << (BITS * most - 1).bit_length()))
    at = (np.concatenate(sets) >> np.uint64(20)) & np.uint64(bits - 1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), bits), dtype=bool)
    out[owner, at.astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def spanning(ids: np.ndarray, label: np.ndarray, block: np.ndarray, split: bool, place: int, sets: list[np.ndarray], keys: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the members of a bucket as far as links among them do.

    Of members of one component no pair is looked at, of those that share an earlier bucket neither. If split, only pairs from
    different blocks are.
    """
    n = np.array([len(s) for s in sets])
    bits: np.ndarray | None = None
    label, links = label.copy(), []
    for i in range(len(ids) - 1):
        near = label[i + 1 :] != label[i]
        near &= 100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i])
        if split:
            near &= block[i + 1 :] != block[i]
        at = np.flatnonzero(near) + i + 1
        if len(at) == 0:
            continue
        at = at[(keys[at, :place] != keys[i, :place]).all(axis=1)]
        if len(at) > 1:
            if bits is None:
                bits, own = bitmaps(sets), None
                own = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            # every bit of one set that the other lacks stands for a hash the other lacks
            both = np.bitwise_count(bits[at] & bits[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[at] - own[at] + both, n[i] - own[i] + both)
            at = at[100 * most >= percent * (n[at] + n[i] - most)]
        for j in at.tolist():
            if label[j] != label[i] and linked(sets[i], sets[j], percent):
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


def few_pairs(group: np.ndarray, place: np.ndarray, label: np.ndarray, sets: list[np.ndarray], keys: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one group (numbered, in order, at most FEW members; -1: none) that may be linked.

    Pairs of one component, or that share an earlier bucket than `place`, are left out, and those whose sizes or bitmaps
    rule a link out.
    """
    n = np.array([len(s) for s in sets])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(FEW, len(group))):
        i = np.flatnonzero((group[d:] == group[:-d]) & (group[d:] >= 0))
        if len(i) == 0:
            break
        i = i[label[i] != label[i + d]]
        i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
        earlier = np.arange(keys.shape[1]) < place[i][:, None]
        i = i[~((keys[i] == keys[i + d]) & earlier).any(axis=1)]
        left.append(i)
        right.append(i + d)
    i, j = np.concatenate(left), np.concatenate(right)
    if len(i) == 0:
        return i, j
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    bits = bitmaps([sets[x] for x in used.tolist()])
    spare = n[used] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    a, b = where[: len(i)], where[len(i) :]
    both = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
    most = both + np.minimum(spare[a], spare[b])
    able = 100 * most >= percent * (n[i] + n[j] - most)
    return i[able], j[able]


def _compared(percent: int, sets: Sets, keys: Keys):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links_of(parts: list[tuple]) -> list[tuple[int, int]]:
            ids, label, block, key, own = (parts[0][k] if len(parts) == 1 else np.concatenate([p[k] for p in parts]) for k in range(5))
            bodies = [s for p in parts for s in p[5]]
            _, place, low, high = parts[0][6]
            return spanning(ids, label, block, low != high, place, bodies, own, percent) if len(ids) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for part in slices(batch, "text"):
                bodies = sets(*utf8(named(part, "text")))
                own = keys(named(part, "sig").to_pylist())
                ids, label, block, key, low, high = (named(part, c).to_numpy() for c in ("id", "label", "block", "key", "low", "high"))
                new = (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
                cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [part.num_rows]])
                size = np.diff(cuts)
                # a group at either end of the part may go on beyond it
                few = (size <= FEW) & (low == high)[cuts[:-1]]
                few[[0, -1]] = False
                number = np.repeat(np.where(few, np.arange(len(size)), -1), size)
                i, j = few_pairs(number, key & (PLACES - 1), label, bodies, own, percent)
                out += [(int(ids[x]), int(ids[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True) if linked(bodies[x], bodies[y], percent)]
                for a, b in zip(cuts[:-1][~few].tolist(), cuts[1:][~few].tolist(), strict=True):
                    group = (int(key[a]), int(key[a]) & (PLACES - 1), int(low[a]), int(high[a]))
                    if held and held[0][6] != group:
                        out += links_of(held)
                        held = []
                    held.append((ids[a:b], label[a:b], block[a:b], key[a:b], own[a:b], bodies[a:b], group))
            yield _pairs(out)
        if held:
            yield _pairs(links_of(held))

    return rows


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])
