"""Whitening against numpy, the residue numbers against Python's integers, and odd rows."""

import math

import numpy as np
import pytest

from graphloom.llm import whitening
from graphloom.llm.queries import op13_whitening
from graphloom.llm.whitening import primes_over, restored, scatter, whiten

ROWS = "vec_id long, embedding array<float>, n string"


def plain(vectors, k=16):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x], (x - s / n) @ w / np.sqrt(e), e / np.trace(v)


def test_equal_to_numpy(spark, tmp_path):
    rnd = np.random.default_rng(1)
    mix = rnd.normal(size=(24, 24)) * np.linspace(0.2, 3, 24)
    vectors = (rnd.normal(size=(700, 24)) @ mix).astype(np.float32)
    vectors[500:] = vectors[:200]
    rows = [(i, [float(x) for x in v], "n") for i, v in enumerate(vectors)]
    bad = [(900, None, ""), (901, [1.0] * 23 + [None], ""), (902, [math.nan] * 24, ""), (903, [math.inf] * 24, ""), (904, [], ""), (905, [1.0, 2.0], "")]
    spark.createDataFrame(rows + bad, ROWS).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op13_whitening(spark, str(tmp_path)).collect()
    n, deviation, z, explained = plain(vectors)
    assert len(got) == 700 * 16 and {r["n"] for r in got} == {n} == {500}
    found = np.zeros((700, 16))
    for r in got:
        assert r["deviation"] == deviation[r["vec_id"]] and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9) and r["identity_error"] < 1e-9
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
    signs = np.sign((found * z).sum(axis=0))
    assert np.abs(found - z * signs).max() < 1e-8
    assert found[:200].tolist() == found[500:].tolist()


def test_large_numbers_stay_exact(spark):
    rnd = np.random.default_rng(2)
    x = [[int(v) for v in row] for row in rnd.integers(-(2**48), 2**48, (40, 3))]
    fit = spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(3)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * v - s for v, s in zip(row, sums)] for row in x]
    bound = 2 * n * max(abs(v) for row in y for v in row) ** 2
    want = [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    assert scatter(fit, n, sums, primes_over(bound)).tolist() == want
    rows = [(i, [float(v) * 2.0**44 for v in row], "") for i, row in enumerate(rnd.normal(size=(30, 3)))]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: sum((30 * v - s) ** 2 for v, s in zip(row, sums)) for i, row in enumerate(x)}
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_residues(monkeypatch):
    primes = primes_over(10**40)
    assert all(p < 1 << whitening.PRIME_BITS and all(p % k for k in range(2, math.isqrt(p) + 1)) for p in primes) and len(set(primes)) == len(primes)
    values = np.array([0, 1, -1, 10**39, -(10**39), 123456789012345678901234567890], object)
    assert restored([np.array([int(v) % p for v in values], np.int64) for p in primes], primes).tolist() == values.tolist()
    assert whitening.ROWS * (max(primes) - 1) ** 2 <= 2**53


@pytest.mark.parametrize("rows, n, components", [([], None, 0), ([(1, None, "")], None, 0), ([(1, [0.5, 1.0], "")], 1, 0), ([(1, [0.5, 1.0], "")] * 3, 1, 0), ([(1, [0.0, 1.0], ""), (None, [4.0, 1.0], "")], 2, 1)])
def test_few_vectors(spark, rows, n, components):
    got = whiten(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == (len(rows) if n else 0)
    assert all(r["n"] == n and len(r["whitened"]) == len(r["explained"]) == components for r in got)


def test_other_columns_stay(spark):
    got = whiten(spark.createDataFrame([(1, [0.0, 1.0], [2.0, 2.0], "y"), (2, [1.0, 3.0], [0.0, 1.0], "z")], "x long, row array<double>, embedding array<float>, deviation string"))
    assert got.columns == ["x", "row", "embedding", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {r["x"]: r["row"] for r in got.collect()} == {1: [0.0, 1.0], 2: [1.0, 3.0]}
