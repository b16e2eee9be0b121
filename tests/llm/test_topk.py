import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import topk


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % 50:
            continue
        found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if a != b)[:k]
        out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(v, i, 0) for i, v in rows], "embedding array<float>, vec_id long, score int").repartition(7)
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, **options).collect())


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [np.float32(rng.choice([-1, 0, 0.5, rng.uniform(-1, 1)])).item() for _ in range(6)]) for i in range(400)]
    rows += [(50, rows[50][1]), (50, rows[3][1]), (7, rows[7][1]), (1000, rows[9][1])]  # repeated rows, ids and vectors
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf"), 1.0]), (None, [1.0] * 6), (2200, []), (2250, [0.25, 1.0])]
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk, "GROUPS", 2)
    assert run(spark, rows, block=3) == want


def test_few_rows(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [0.5, -1.0])]) == [(0, 1, 1, 256 * 128 - 512 * 256)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(3, [1.0]), (4, [1.0])]) == []


def test_wide_values(spark):
    rows = [(0, [1e10, -3.0]), (1, [2e10, 7.0]), (2, [-1e10, 5.0]), (3, [1.0, 1.0])]
    rows = [(i, [np.float32(x).item() for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows)


def test_tiles(monkeypatch):
    monkeypatch.setattr(topk, "TILE", 8)
    rng = np.random.default_rng(0)
    q, s, ids = rng.integers(-5, 5, (4, 3)).astype(float), rng.integers(-5, 5, (60, 3)).astype(float), np.arange(60) * 2
    found = None
    for t in range(0, 60, 8):
        found = topk.merge(found, topk.best_of_tile(q, s[t : t + 8], ids[t : t + 8], 5), 5)
    for i in range(4):
        want = sorted((-int(q[i] @ s[j]), int(ids[j])) for j in range(60))[:5]
        order = np.lexsort((found[0][i], -found[1][i]))
        assert [(-int(x), int(y)) for x, y in zip(found[1][i][order], found[0][i][order])] == want


def test_matrix():
    x, ok = topk.matrix(pa.array([[0.5, -0.001], None, [1.0], [None], []], pa.list_(pa.float64())))
    assert ok.tolist() == [True, False, True, False, True] and x[0].tolist() == [128, -1] and x[2].tolist() == [256, 0]
