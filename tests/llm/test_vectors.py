"""Near-equal vectors and exact Hamming search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import vectors
from tablewright.llm.hamming_search import sign_code, top_k


def clusters():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 24))
    rows = [(i, (centre[i % 4] + rng.normal(size=24) * (0.08 + 0.1 * (i % 3))).tolist(), i % 2) for i in range(300)]
    return rows + [(1000 + i, rows[0][1], rows[0][2]) for i in range(50)]


def brute(rows, cosine):
    units = np.array([v for _, v, _ in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    labels = np.array([x for _, _, x in rows])
    linked = (units @ units.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    least = np.array([i for i, _, _ in rows])
    for _ in range(len(rows)):
        least = np.minimum(least, np.where(linked, least[None, :], 10**9).min(axis=1))
    return {i: (int(n), int(c)) for (i, _, _), n, c in zip(rows, linked.sum(axis=1), least, strict=True)}


@pytest.mark.parametrize("block", [2048, 40])
def test_near_equal(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = clusters()
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_equal(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute(rows, 0.98)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 0
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_near_equal_edge_cases(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0, 1), (2, [2.0, 4.0, 6.0], 0, 1), (3, one, None, 1), (4, None, 0, 1), (5, [0.0, -0.0, 0.0], 0, 1), (6, [1.0, None, 3.0], 0, 1), (7, [float("nan"), 2.0, 3.0], 0, 1),
        (8, [float("inf"), 2.0, 3.0], 0, 1), (9, [], 0, 1), (10, [1.0, 2.0], 0, 1), (11, one, 1, 1), (1, one, 0, 1), (None, one, 0, 1), (12, [1e300, 2e300, 3e300], 0, None),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, point int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_equal(frame).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(0, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (12, 2, 1, False), *alone])
    assert vectors.near_equal(frame.limit(0)).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(8)
    codes = [(i, int(x)) for i, x in enumerate(rng.integers(-(1 << 63), 1 << 62, 300))] + [(400 + i, -1) for i in range(30)] + [(500, None), (None, 5), (0, None)]
    frame = spark.createDataFrame(codes, "id long, code long")
    wanted = frame.where("id in (0, 50, 400)")
    known = [(i, c) for i, c in codes if i is not None and c is not None]
    for k in (3, 12):
        got = {}
        for r in top_k(frame.unionByName(frame.limit(5)), wanted, k).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
        for q, code in known:
            if q in (0, 50, 400):
                assert got[q] == sorted((bin((code ^ c) & (1 << 64) - 1).count("1"), i) for i, c in known if i != q)[:k]
    assert top_k(frame.limit(0), wanted.limit(0)).collect() == []
    few = spark.createDataFrame([(1, 7), (2, 8)], "id long, code long")
    assert [(r.query_id, r.neighbor_id, r.distance) for r in top_k(few, few.where("id = 1"), 5).collect()] == [(1, 2, 4)]


def test_sign_code(spark):
    frame = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0],), ([float("nan")],), (None,), ([],), ([1.0] * 64,)], "v array<double>")
    assert [r[0] for r in frame.select(sign_code("v")).collect()] == [9, None, None, None, -1]
    assert frame.select(F.bit_count(sign_code("v"))).collect()[4][0] == 64
