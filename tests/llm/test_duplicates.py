"""Near-duplicate documents and fuzzy lines against brute force, and their edge cases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import buckets
from tablewright.llm.line_duplicates import dedup_lines
from tablewright.llm.near_duplicates import near_duplicates
from tablewright.llm.store import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked_pairs(sets, percent):
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                yield i, j


def expected(rows):
    sets = {i: shingles(t) for i, t in rows}
    union = Union()
    for i, j in linked_pairs(sets, 75):
        union.join(i, j)
    return {i: (len(s), union.top(i), union.top(i) == i) for i, s in sets.items()}


def test_near_duplicates_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_one_large_group(spark):
    """Copies with ever more edits of their own: links only where the similarity says so."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = base.copy()
        for j in range(i % 15):
            words[(j * 8 + i) % 120] = f"edit{i}x{j}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected(rows)


def test_near_duplicates_in_split_blocks(spark, monkeypatch):
    """The same answer without pivots, from buckets dealt into many small blocks."""
    monkeypatch.setattr(buckets, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(buckets, "BLOCK", 16)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if (j * 7 + i) % 40 >= i % 6 else f"edit{i}x{j}" for j, w in enumerate(base))) for i in range(90)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected(rows)


def test_bitmaps_never_rule_out_a_link():
    random = np.random.default_rng(5)
    pool = random.integers(0, 1 << 63, 400, dtype=np.uint64)
    for size in (1, 5, 60, 300):
        sets = [np.unique(random.choice(pool, size)) for _ in range(30)]
        keys = np.zeros((30, 1), dtype=np.int64)
        links = buckets.spanning(np.arange(30), np.arange(30), np.zeros(30, np.int32), False, 0, sets, keys, 75)
        union, want = Union(), Union()
        for a, b in links:
            union.join(a, b)
        for a, b in linked_pairs({i: set(x.tolist()) for i, x in enumerate(sets)}, 75):
            want.join(a, b)
        assert [union.top(i) for i in range(30)] == [want.top(i) for i in range(30)]


def test_near_duplicates_edge_cases(spark):
    rows = [
        (5, None, "x", 1), (6, "", "x", 1), (7, " \t\n", None, None), (8, "One two  THREE", "x", 1), (9, "one two three", "x", 1), (9, "one two three", "x", 1),
        (10, "one two four", "x", 1), (None, "one two three", "x", 1), (11, "long " * 30000, "x", 1), (12, "long " * 29000, "x", 1), (13, "a b c d e f g", "x", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sig string, n int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame).collect())
    assert got == [
        (-1, 1, None, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (9, 1, 8, False),
        (10, 1, 10, True), (11, 1, 11, True), (12, 1, 11, False), (13, 3, 13, True),
    ]
    assert near_duplicates(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(frame, percent=50)


def test_near_duplicates_at_the_threshold(spark):
    """Pairs with 6 of 8 shingles in common, exactly 0.75, each the only link of its documents."""
    rows = []
    for i in range(5000):
        words = [f"w{i}x{j}" for j in range(11)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], f"other{i}"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = expected(rows)
    assert all(top == i // 2 * 2 for i, (_, top, _) in want.items())
    assert [i for i in want if got[i] != want[i]] == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (None, 5), (50, 49)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 49: 49, 50: 49}


def line_shingles(line):
    line = line.translate(LOWER).strip()
    return {line[i : i + 8] for i in range(len(line) - 7)} if len(line) >= 8 else {line}


def deduplicated(rows):
    lines = [(i, n, x.translate(LOWER).strip()) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip()]
    union = Union()
    for a, b in linked_pairs({x: line_shingles(x) for x in {x for _, _, x in lines}}, 80):
        union.join(a, b)
    seen, gone = set(), set()
    for i, n, x in sorted(lines):
        if (top := union.top(x)) in seen:
            gone.add((i, n))
        seen.add(top)
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_lines_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    want = deduplicated([(r.doc_id, r.text) for r in docs.collect()])
    wrong = sum(got[i] != want[i] for i in want)
    assert len(got) == len(want) and wrong <= len(want) // 200  # signatures may miss a pair at the border


def test_lines_edge_cases(spark):
    rows = [
        (1, "Alpha beta gamma delta epsilon\n\nshort\nonly here", "k"), (2, "alpha beta gamma delta epsilon!\nshort \n\nbut this is new text", "k"), (3, None, None),
        (4, "", "k"), (5, "x" * 200000 + "\nshort", "k"), (None, "nobody's line is the first", "k"), (6, "nobody's line is the first", "k"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.line) for r in dedup_lines(frame).collect()}
    assert got[1] == ("Alpha beta gamma delta epsilon\n\nshort\nonly here", 4, 0, "k")
    assert got[2] == ("\nbut this is new text", 4, 2, "k")
    assert got[3] == (None, 0, 0, None) and got[4] == ("", 1, 0, "k")
    assert got[5][0] == "x" * 200000 and got[None][0] == "nobody's line is the first" and got[6][0] == ""
    assert dedup_lines(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        dedup_lines(frame.withColumnRenamed("line", "n_lines"))


def test_entries_are_shuffled_once(spark):
    """Entries that come several times give each bucket once, and one shuffle of them serves the count and the join."""
    rows = [(k << 6 | p, i) for i in (1, 2, 2, 3) for p, k in enumerate((7, 8, 9 if i < 3 else 10))]
    entries = spark.createDataFrame(rows, "key long, id long")
    found = buckets.shared_buckets(entries)
    assert sorted(tuple(r) for r in found.collect()) == [(7 << 6, 1), (7 << 6, 2), (7 << 6, 3), (9 << 6 | 2, 1), (9 << 6 | 2, 2)]
    with_size = buckets.shared_buckets(entries.withColumn("n", entries.id + 1))
    assert sorted(r.n for r in with_size.collect()) == [2, 2, 3, 3, 4]
    for frame in (found, with_size):
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
        assert sum("REPARTITION_BY_COL" in x and "ReusedExchange" not in x for x in plan) == 1


def test_few_pairs_are_those_of_the_full_comparison(monkeypatch):
    """Small buckets compared together join the same members as each compared alone."""
    random = np.random.default_rng(8)
    pool = random.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets, group = [], []
    for g in range(60):
        base = random.choice(pool, int(random.integers(1, 60)), replace=False)
        for _ in range(int(random.integers(1, buckets.FEW + 1))):
            group.append(g)
            sets.append(np.unique(np.concatenate([base[: max(1, int(len(base) * random.uniform(0.6, 1)))], random.choice(pool, int(random.integers(0, 8)))])))
    group, n = np.array(group), len(sets)
    keys = random.integers(0, 6, (n, 4))
    label, place = random.integers(0, 3 * n, n), np.array([g % 4 for g in group])
    i, j = buckets.few_pairs(group, place, label, sets, keys, 80)
    got, want = Union(), Union()
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if buckets.linked(sets[a], sets[b], 80):
            got.join(a, b)
    for g in range(60):
        at = np.flatnonzero(group == g)
        for a, b in buckets.spanning(at, label[at], np.zeros(len(at), np.int32), False, g % 4, [sets[x] for x in at], keys[at], 80):
            want.join(a, b)
    assert len(i) and [got.top(x) for x in range(n)] == [want.top(x) for x in range(n)]


def test_entries_are_read_once(spark):
    """Counting and choosing share one pass over the shuffled entries."""
    rows = [(k << 6 | k, i) for i in range(4) for k in range(i, 9)]
    found = buckets.shared_buckets(spark.createDataFrame(rows, "key long, id long"))
    assert sorted(tuple(r) for r in found.collect()) == [(k << 6 | k, i) for k in (1, 2, 3) for i in range(k + 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    assert sum("REPARTITION_BY_COL" in x for x in plan) == 1


def test_keys_met_across_batches():
    """Keys that go on over batches of any size, with entries that come several times."""
    random = np.random.default_rng(3)
    key, ids = np.sort(random.integers(0, 60, 200)), random.integers(0, 3, 200)
    want = {(k, i) for k, i in zip(key.tolist(), ids.tolist(), strict=True) if len(set(ids[key == k].tolist())) > 1}
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], names=["key", "id"])
    for size in (1, 2, 3, 7, 200):
        got = [r for x in buckets._met(whole.slice(i, size) for i in range(0, 200, size)) for r in zip(x["key"].to_pylist(), x["id"].to_pylist(), strict=True)]
        assert set(got) == want and all(got.count(r) <= int(((key == r[0]) & (ids == r[1])).sum()) for r in want)
