"""Quality rules, divergence audit and conversation repair against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import conversations, divergence, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


# --- quality ------------------------------------------------------------------------------------


def counted(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "a b c d e f\n\na b c d e f\n a b c d e f", "x" * 40_000, "é 🙂 日本 語 # | < $$$",
    "one\x0btwo\x0cthree\rfour\tfive six one two three four five", "w " * 3_000, " ".join(f"w{i % 700}" for i in range(5_000)), " ".join(f"v{i}" for i in range(9_000)),
]


def test_counts_equal_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6 + i, t) for i, t in enumerate(TEXTS)]
    rows = quality.measure(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(texts[r.doc_id]), r.doc_id


def test_verdict_adapts_to_the_group(spark):
    """What is usual in one source is out of line in another; junk in a third of a group doesn't move its thresholds."""
    def prose(i, marks):
        return " ".join(f"w{(i * 31 + j * 7) % 997}x" + ("#" if marks and j % 2 else "") for j in range(60))

    plain = [(i, prose(i, False), "en", "plain") for i in range(200)]
    tables = [(1_000 + i, prose(i, True), "en", "tables") for i in range(200)]
    odd = [(2_000 + i, prose(i, True), "en", "plain") for i in range(100)]
    small = [(3_000, prose(1, False), "en", "new"), (3_001, prose(1, False), None, None)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(plain + tables + odd + small, DOCS)).collect()}
    assert all(kept[d[0]] for d in plain + tables + small) and not any(kept[d[0]] for d in odd)


def test_verdict_agrees_with_quality_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{folder}/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")]))
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) >= 0.98


def test_sketches_merge_in_any_order(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 50 + 1), "en", f"s{i % 3}") for i in range(300)], DOCS)
    one = quality.sketches(quality.measure(docs.coalesce(1)), ["lang"])
    many = quality.sketches(quality.measure(docs.repartition(7)), ["lang", "source"]).groupBy("lang", "measure", "bin").sum("n")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_quality_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality.judge(empty).count() == 0
    twice = quality.judge(spark.createDataFrame([(1, None, None, "s"), (1, None, None, "s"), (None, "a b", "en", None)], DOCS + "").withColumnRenamed("doc_id", "id")).collect()
    assert [(r.base_failed, r.kept) for r in twice] == [(True, False)] * 3
    with pytest.raises(ValueError):
        quality.judge(empty.selectExpr("*", "1 as kept"))
    with pytest.raises(ValueError):
        quality.measure(empty.selectExpr("*", "1 as N_Words"))


# --- divergence ---------------------------------------------------------------------------------


def audited(rows):
    """The contract in plain Python."""
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, n in seen.items() if n >= 3)
        groups = defaultdict(Counter)
        for _, source, terms in own:
            groups[source].update({t: terms[t] for t in kept})
        whole = sum(groups.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(whole)
        price = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = [(o, sum(price(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, price(p[s][t], q[t])) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_audit_equals_brute_force(spark, tiny, monkeypatch):
    columns = ["doc_id", "text", "lang", "source"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select(*columns)
    rows = [tuple(r) for r in docs.collect()]
    rows += [(None, None, None, None), (7, "Zebra zebra; ZEBRA", "", "s"), (8, "zebra", None, "t"), (9, "1 2 3", "xx", "a"), (9, "é", "xx", "b"), (10, "Łł_日本-ok", "yy", None)] * 2
    found = divergence.audit(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, found.collect())) == audited(rows)
    # more segments, blocks and flushes than the small table needs
    for name, value in (("SEGMENT", 64), ("BLOCK", 3)):
        monkeypatch.setattr(divergence, name, value)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(divergence)
    try:
        assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS)).collect())) == audited(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(divergence)


def test_trees_share_equal_subtrees():
    counts = np.array([[1, 0, 0, 0, 1, 0, 0, 0], [1, 0, 0, 0, 1, 0, 0, 0], [1, 0, 0, 0, 0, 0, 0, 0]])
    values, levels, roots = divergence.build_trees(counts)
    assert roots[0] == roots[1] != roots[2] and [len(x) for x in levels] == [2, 2, 2]
    a, b, times = divergence.walk(levels, int(roots[0]), int(roots[2]))
    assert {(values[x], values[y]): n for x, y, n in zip(a, b, times)} == {(1, 1): 1, (1, 0): 1, (0, 0): 6}


def test_partial_counts_lose_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    texts = [b"a b c d e", b"a A b", b"", b"f g h a"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(["x"] * 20), pa.array(["s"] * 20)], names=["text", "lang", "source"])
    n, docs = Counter(), Counter()
    for part in divergence._counted(iter([batch, batch])):
        for r in part.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert n["a"] == 40 and docs["a"] == 30 and n["h"] == docs["h"] == 10


def test_audit_edges(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "same words here", "en", "s") for i in range(4)] + [(9, "!!", "en", "t")]
    found = divergence.audit(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as rank", "'x' as term"))
    assert sorted(map(tuple, found.collect())) == audited(rows)


# --- conversations ------------------------------------------------------------------------------


def first_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, prune):
    """Least cost, then least string of edits, by searching strings in that order."""
    faults = first_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, said = heapq.heappop(heap)
        if not re.fullmatch(r"s?((ua)*u?)", roles):
            continue
        if prune:
            if (i, roles[-1:]) in done:
                continue
            done.add((i, roles[-1:]))
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, "\n".join(said)
        for role in ("user", "assistant"):
            if prune or len(roles) < len(rows) + 3:
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role[0], (*said, f"{role}:")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, said))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if own and own[0] in "sua":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + own[0], (*said, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + role[0], (*said, f"{role}:{text}")))


def expected(rows, prune=True):
    """rows of one conversation after damage: (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    found = Counter(first_faults(rows))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, text = cheapest(rows, prune)
    return gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def broken(rows):
    """The damage of the contract, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if draw != 0:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            out[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


TURNS = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, schema=TURNS):
    found = conversations.repair(conversations.damage(spark.createDataFrame(rows, schema))).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r)[1:] for r in found}


def test_repair_equals_search_on_the_table(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(spark, rows) == {c: expected(own) for c, own in broken(rows).items()}


def test_repair_equals_exhaustive_search(spark):
    draw = random.Random(5)
    rows = []
    for conv in range(250):
        for turn in range(draw.randint(0, 5)):
            role = draw.choice(["user", "assistant", "system", "tool", None])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), role, draw.choice(["Yes.", "No", "", "Why?", f"t{turn}!", None, "é\n"])))
    assert repaired(spark, rows) == {c: expected(own, prune=False) for c, own in broken(rows).items()}


@pytest.mark.parametrize("roles", [["system"], ["user"], ["assistant"], ["user", "assistant"], ["tool", "user", "system"]])
def test_repair_of_a_long_conversation_spans_batches(spark, roles):
    rows = [(1, i, roles[i % len(roles)], f"text {i}" + (". " if i % 3 else "")) for i in range(700)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert repaired(spark, rows) == {1: expected(broken(rows)[1])}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repair_edges(spark):
    assert repaired(spark, []) == {}
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (2, None, "user", "a."), (2, None, "user", "a."), (3, 5, "", "x.")]
    assert repaired(spark, rows) == {c: expected(own) for c, own in broken(rows).items()}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: expected([])}
    named = [(1, "c1", 1, "user", "Hi.", 0), (2, "c1", 2, "assistant", "Ho.", 0)]
    found = repaired(spark, named, "extra int, conv_id string, turn int, role string, text string, cost int")
    assert found == {c: expected(own) for c, own in broken([r[1:5] for r in named]).items()}
