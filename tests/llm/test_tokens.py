"""Byte-level BPE against tiktoken, packing against tokenizers, the cutting-stock program."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tablewright.llm import bpe, cutting_stock, packing, pretoken

MULTI = public.path("byte_bpe_multi_50k.tiktoken")
JSON = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own(text):
    raw = text.encode()
    words, _ = pretoken.split(raw, np.array([0, len(raw)]))
    return [i for w in words for i in bpe.merged(w.encode(), bpe.ranks_of(MULTI))]


PARTS = ["'", "s", "t", "re", "ve", "ll", "'s", " '", " ", "  ", "\n", "\t", " ", "　", "a", "É", "ß", "1", "²", "Ⅷ", "!", "日本", "🙂", "é", "​", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=20))
def test_ids_as_tiktoken(reference, parts):
    text = "".join(parts)
    assert own(text) == reference.encode_ordinary(text)


def test_long_slices(reference):
    for text in ("a" * 3000, "ab" * 2500 + " " * 500 + "x", "日本語" * 700, "!?" * 900 + "\n" * 300):
        assert own(text) == reference.encode_ordinary(text)


EDGES = [(1, None, "a"), (2, "", "b"), (3, "It's  we'll\n\n 'twas 3.14 日本", None), (3, "It's  we'll\n\n 'twas 3.14 日本", None), (None, "no id", "c"), (4, "word " * 20000, "d")]


def test_digests(spark, tiny, reference):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digests(docs, MULTI).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_and_decode(spark, reference):
    frame = spark.createDataFrame(EDGES, "doc_id long, text string, token string")
    rows = bpe.decode(bpe.encode(frame, MULTI), MULTI).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        text = (r.text or "").encode()
        assert bytes(r.decoded) == text and r.ids == reference.encode_ordinary(r.text or "")
        assert all(text[a:].startswith(bpe.bytes_of(MULTI)[i]) for a, i in zip(r.id_offsets, r.ids, strict=True))
    assert bpe.encode(frame.limit(0), MULTI).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(frame.withColumnRenamed("token", "IDS"), MULTI)


def check_pieces(rows, texts):
    """Every id of every row in exactly one piece, gapless sequences of at most 2048; gives the share of padding."""
    tokenizer = Tokenizer.from_file(JSON)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in texts}
    copies = defaultdict(int)
    for i, _ in texts:
        copies[i] += 1
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        covered = np.zeros(len(ids) // 4, dtype=int)
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies[i]).all()
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / (total + padding)


def test_packing_added_tokens(spark):
    """Literals of the vocabulary's added tokens have the ids that the tokenizer as loaded gives them."""
    tokenizer = Tokenizer.from_file(JSON)
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "é<|endoftext|><|endoftext|>\n x", 4: "no <|endoftext| here", 5: "word " * 3000 + "<|endoftext|> end"}
    assert 50256 in tokenizer.encode(texts[1], add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), JSON).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        assert r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])


def test_packing(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = packing.pack(docs, JSON).collect()
    assert check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()]) < 0.02


def test_packing_edge_cases(spark):
    frame = spark.createDataFrame(EDGES, "doc_id long, text string, length string")
    assert check_pieces(packing.pack(frame, JSON).collect(), [(i, t) for i, t, _ in EDGES]) < 0.02
    assert packing.pack(frame.limit(0), JSON).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame, JSON, length=1000)


def test_packing_one_length(spark):
    """One length that fills the table is dealt to many sequences."""
    rows = [(i, "alpha beta gamma " * 50) for i in range(700)]
    assert check_pieces(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), JSON).collect(), rows) < 0.25


def test_cutting_stock():
    counts = np.zeros(128, dtype=np.int64)
    counts[[63, 42, 84, 9]] = [100, 300, 300, 1000]
    patterns, uses = cutting_stock.solve(counts, 128)
    assert np.allclose(uses @ patterns, counts, rtol=1e-3) and (patterns @ np.arange(1, 129) <= 128).all()
    assert uses.sum() <= 1.01 * (counts * np.arange(1, 129)).sum() / 128 + 1
    assert cutting_stock.best_pattern(np.array([0.0, 1.0, 1.6]), 7)[0] == pytest.approx(3.6)


def encoded_by(known, texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(x.encode()) for x in texts)])
    text, cut, places, first = pretoken.cuts(data, offsets)
    ids, begin = known.encoded(data, text, cut, places)
    at = begin[first]
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([*PARTS[:-1], "abcdefghijklmno", "pq"]), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=12), max_size=6))
def test_remembered_words(parts):
    """Ids by a table of few places, in which words take each other's place, are those of the tokenizer."""
    texts = ["".join(x) for x in parts]
    tokenizer = packing.tokenizer_of(JSON)
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "PLACES", 8)
        patch.setattr(packing, "IDS", 40)
        known = packing.Words(JSON)
        assert encoded_by(known, texts) == want
        assert encoded_by(known, texts[::-1]) == want[::-1]


def test_words_are_encoded_once(monkeypatch):
    """Pre-tokens that a process has met in another task don't go through the tokenizer again."""
    sent = []
    made = packing.Words._made
    monkeypatch.setattr(packing.Words, "_made", lambda self, words: (sent.extend(words), made(self, words))[1])
    texts = [f"einmal zweimal{i} dreimal übermäßigelangewörter" for i in range(40)] * 3
    first = encoded_by(packing.words_of(JSON), texts)
    assert len(sent) == len(set(sent) - {" übermäßigelangewörter"}) + sent.count(" übermäßigelangewörter")
    sent.clear()
    assert encoded_by(packing.words_of(JSON), texts) == first
    assert len(sent) <= len(texts) + 4  # the words beyond 15 bytes, and ones that fell on one place
