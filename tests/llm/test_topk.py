"""Exact search against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import topk


def plain(rows, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = [math.floor(1024 * x) for x in v]
    out = set()
    for q in ints:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            out |= {(q, r, i, max(min(-s, 2**63 - 1), 1 - 2**63)) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def search(spark, rows, kind="float"):
    frame = spark.createDataFrame([(i, v, 1, "b") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, block string")
    return {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, 10).collect()}


def test_random_vectors_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 200)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    monkeypatch.setattr(topk, "EXTENTS", 2)
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.choice([-0.5, 0.1, 0.25, rng.random()]))) for _ in range(6)]) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(50)]
    assert search(spark, rows) == plain(rows, 10)


def test_blocks_that_cannot_count_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((20, 8)) * np.array([1, 6])[rng.integers(0, 2, 20)][:, None]
    rows = [(i, [float(x) for x in centers[i % 20] + rng.standard_normal(8) * 0.05]) for i in range(2000)]
    assert search(spark, rows, "double") == plain(rows, 10)
    # Extents of blocks bound every score in them.
    ids, x = np.arange(100), rng.integers(-500, 500, (100, 4))
    pivots = topk.choose_pivots(x[:30], 6)
    far = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], 1)
    squares = (x.astype(float) ** 2).sum(1)
    for q in ids:
        gap = np.maximum(np.maximum(far[:50].min(0) - far[q], far[q] - far[:50].max(0)), 0).max()
        assert topk._most(squares[:50].max() + squares[q], gap) >= (x[:50] @ x[q]).max()


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (100, []), (6, [1.0]), (7, [3.0, -1.0]), (200, [1e30, 1.0]), (8, [-1e30, 2.0]), (None, [1.0, 1.0])]
    clipped = [(i, v) for i, v in rows if i not in (200, 8)]
    assert search(spark, clipped) == plain(clipped, 10)
    huge = search(spark, rows)
    assert {(q, r, i) for q, r, i, _ in huge if q == 200} == {(200, 1, 0), (200, 2, 7), (200, 3, 8)}
    assert {s for q, _, i, s in huge if (q, i) == (200, 8)} == {1 - 2**63}
    assert search(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]) == {(0, 1, 1, 1024 * 2048)}
    assert search(spark, []) == set()


def test_given_vectors(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, 10).collect()}
    assert got == plain([(r.vec_id, r.embedding) for r in frame.collect()], 10)
