"""Exact top-k search against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from precis.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 10 == 0}):
        own = min(v for i, v in usable if i == q)
        scored = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def found(spark, rows, k=10, schema=SCHEMA):
    vectors = spark.createDataFrame(rows, schema).repartition(3)
    got = topk.search(vectors, F.col("vec_id") % 10 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], "x") for i in range(400)]
    rows += [(1000 + i, rows[3][1], "x") for i in range(30)]  # ties
    rows += [(7, rows[7][1], "x"), (20, rows[20][1], "x")]  # repeated rows
    assert found(spark, rows) == brute(rows, 10)
    assert found(spark, rows, 3) == brute(rows, 3)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], ""), (1, [0.5, float("nan")], ""), (2, None, ""), (3, [float("inf"), 0.0], ""),
            (4, [-0.0005, 3.0], ""), (5, [1.0], ""), (10, [], ""), (6, [], ""), (20, [1e30, -1e30], ""),
            (None, [1.0, 1.0], ""), (30, [None, 1.0], ""), (40, [0.1, 0.1, 0.1], "")]
    got = found(spark, rows)
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert got == sorted((q, r, i, clip(s)) for q, r, i, s in brute(rows, 10))
    assert found(spark, []) == []


def test_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    queries = np.floor(rng.normal(size=(40, 50)) * 1024)
    candidates = np.vstack([queries[:10] + 1, np.floor(rng.normal(size=(300, 50)) * 300)])
    ids = np.arange(310)
    q, c, s = topk.best_in_blocks(np.arange(1000, 1040), queries, ids, candidates, 5)
    exact = queries @ candidates.T
    for i in range(40):
        best = sorted(range(310), key=lambda j: (-exact[i, j], j))[:5]
        mine = [(c[k], s[k]) for k in range(len(q)) if q[k] == 1000 + i]
        assert mine == [(j, int(exact[i, j])) for j in best]
