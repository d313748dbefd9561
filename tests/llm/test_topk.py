"""Top-k search against brute force, on odd vectors, and that blocks are pruned where vectors are alike."""

import math

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import topk


def brute(rows, k=5):
    whole = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[n] = (i, [math.floor(x * 256) for x in v])
    queries = {}
    for i, v in whole.values():
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for q, v in queries.items():
        scored = sorted((-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(v, w)))), i) for i, w in whole.values() if i != q)
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **more).collect()}


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(300)]
    rows += [(301, None), (302, [1.0, float("nan")]), (303, [None, 1.0]), (304, [float("inf")]), (None, [1.0] * 8), (305, [0.0] * 8), (306, [1.0, 2.0]), (307, [])]
    rows += [rows[7], rows[50], (100, [float(x) for x in rnd.normal(size=8)])]
    assert found(spark, rows) == brute(rows) == found(spark, rows, in_range=70)
    assert found(spark, rows[:1]) == set() and found(spark, [r for r in rows if r[0] == 1]) == set()


def test_huge_components(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 13), 3.0, -(10.0 ** (i % 7))]) for i in range(120)] + [(150, [1e300, -1e300, 1e18]), (151, [-1e300, 2.0, 1.0])]
    assert found(spark, rows) == brute(rows)


def test_like_vectors_are_pruned():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 32)) * 400
    matrix = np.floor(np.repeat(centres, 100, axis=0) + rnd.normal(size=(4000, 32)) * 8)
    shuffled = rnd.permutation(4000)
    blocks = topk.Blocks(shuffled.astype(np.int64), matrix[shuffled])
    for q in range(0, 4000, 200):
        got = blocks.search(q, matrix[q], 5)
        every = sorted((-int(s), i) for i, s in enumerate(matrix @ matrix[q]) if i != q)[:5]
        assert got == [(-s, i) for s, i in every]
    assert blocks.scored < 20 * len(blocks.index) / 3
