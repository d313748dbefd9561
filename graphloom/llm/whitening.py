"""Whitening of integer vectors from an exact scatter in residue numbers.

The fit list holds each distinct vector x once. With its size n and sums S, y = n x - S is an exact, centred integer
vector. Tasks multiply the residues of their y by themselves, one matrix product for each of several primes, in which
no entry passes what a double holds exactly; sums of residues are reduced by prime, and Chinese remaindering
gives the integers of sum(y y'), which is n^3 times the covariance. Its eigenvectors are then found in doubles.
"""

from __future__ import annotations

from fractions import Fraction
from math import isqrt, prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, without

#: Primes lie below 2^PRIME_BITS, and a product has so many rows that its entries stay below 2^53.
PRIME_BITS = 22
ROWS = 1 << (53 - 2 * PRIME_BITS)
#: Entries of this size or more (after scaling) count as not finite.
LIMIT = 2.0**52
#: Eigenvalues up to this share of the largest are rounding, not variance.
NEGLIGIBLE = 1e-13


def integers(vector: Column, scale: float = 64, offset: int = 1_000_000) -> Column:
    """``floor(scale * c) + offset`` of each entry; null if the vector is null, empty, or holds null or non-finite entries."""
    c = F.transform(vector, lambda v: v.cast("double") * scale)
    good = (F.size(vector) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v) < LIMIT))
    return F.when(good, F.transform(c, lambda v: F.floor(v) + offset))


def primes_over(bound: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS whose product passes ``bound``."""
    found, at = [], (1 << PRIME_BITS) - 1
    while not found or prod(found) <= bound:
        if all(at % k for k in range(3, isqrt(at) + 1, 2)):
            found.append(at)
        at -= 2
    return found


def restored(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers (as Python's) with these residues, by mixed radix digits; each is under half the primes' product."""
    total, base = residues[0].astype(object), primes[0]
    for r, p in zip(residues[1:], primes[1:]):
        total = total + base * ((r - total) * pow(base, -1, p) % p)
        base *= p
    return np.where(total > base // 2, total - base, total)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray, small: bool) -> np.ndarray:
    """y = n x - S exactly: in 64 bits where they hold, else in Python's integers."""
    return x * n - sums.astype(np.int64) if small else x.astype(object) * n - sums


def scatter(fit: DataFrame, n: int, sums: list[int], primes: list[int]) -> np.ndarray:
    """sum(y y') over the fit list, exact."""
    d = len(sums)
    shift = {p: np.array([s % p for s in sums], np.int64) for p in primes}

    def products(batches):
        total = {p: np.zeros((d, d), np.int64) for p in primes}
        for batch in batches:
            x = matrix(batch.column(0))
            for p in primes:
                y = ((x % p * (n % p) - shift[p]) % p).astype(np.float64)
                for at in range(0, len(y), ROWS):
                    part = y[at : at + ROWS]
                    total[p] = (total[p] + (part.T @ part).astype(np.int64)) % p
        for k, p in enumerate(primes):
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array([k] * (d - i), pa.int32()), pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32()), pa.array(total[p][i, i:])], ["k", "i", "j", "r"])

    # d (d + 1) / 2 numbers a prime: the size of the result, however many rows there are.
    found = fit.select("x").mapInArrow(products, "k int, i int, j int, r long").groupBy("k", "i", "j").agg(F.sum("r").alias("r")).toArrow()
    k, i, j, r = (found[c].to_numpy() for c in ("k", "i", "j", "r"))
    residues = []
    for at, p in enumerate(primes):
        own, m = k == at, np.zeros((d, d), np.int64)
        m[i[own], j[own]] = m[j[own], i[own]] = r[own] % p
        residues.append(m)
    return restored(residues, primes)


def whiten(df: DataFrame, vector: str = "embedding", *, components: int = 16, scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` with n, deviation, whitened, explained (arrays by component, falling eigenvalue) and identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries (or entries of 2^52 / scale and more) are left
    out, and so are those of another length than most have (ties: the longer). Repeated vectors are fitted once and
    each row is returned. Components without variance do not exist: fewer than ``components`` are returned where the
    fit list has fewer, and none (empty arrays) where all its vectors are equal. An empty table gives no rows. Columns
    named like the output's are replaced, others stay under any name. ``deviation`` is a decimal of 38 digits.
    """
    spark, own = df.sparkSession, without(df, ("n", "deviation", "whitened", "explained", "identity_error"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), integers(F.col(f"`{vector}`"), scale, offset).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    rows = rows.where(F.size("x") == d)
    fit = cut(rows.select("x").distinct())
    at = range(d)
    total = fit.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in at), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("top")).first() if d else None
    n = total["n"] if d else 0
    sums = [int(total[f"s{k}"]) for k in at] if n else []
    top = 2 * n * total["top"] if n else 0
    small = d * top * top < 1 << 62
    if n:
        whole = scatter(fit, n, sums, primes_over(2 * n * top * top))
        cube = n**3
        v = np.array([[float(Fraction(int(e), cube)) for e in line] for line in whole]).reshape(d, d)
        values, vectors = np.linalg.eigh(v)
        order = [k for k in np.argsort(-values, kind="stable") if values[k] > NEGLIGIBLE * values.max(initial=0)][:components]
        values, vectors, trace = values[order], vectors[:, order], float(np.trace(v))
    else:
        values, vectors, trace = np.zeros(0), np.zeros((d, 0)), 1.0
    projection, whole_sums, c = vectors / np.sqrt(values), np.array(sums, object), len(values)

    def project(y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / n) @ projection

    def spread(batches):
        total = np.zeros((c, c))
        for batch in batches:
            z = project(centred(matrix(batch.column(0)), n, whole_sums, small))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(c), c), pa.int32()), pa.array(np.tile(np.arange(c), c), pa.int32()), pa.array(total.ravel())], ["i", "j", "z"])

    error = 0.0
    if c:
        found = fit.mapInArrow(spread, "i int, j int, z double").groupBy("i", "j").agg(F.sum("z").alias("z")).toArrow().to_pydict()
        error = max(abs(z / n - (i == j)) for i, j, z in zip(found["i"], found["j"], found["z"]))

    def applied(batches):
        for batch in batches:
            y = centred(matrix(batch.column("x")), n, whole_sums, small)
            deviation = pc.cast(pa.array((y * y).sum(axis=1)), pa.decimal128(38, 0)) if small else pa.array([int(s) for s in (y * y).sum(axis=1)], pa.decimal128(38, 0))
            z = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * c, pa.int32()), pa.array(project(y).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), deviation, z], ["row", "deviation", "whitened"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(applied, f"row {kind}, deviation decimal(38,0), whitened array<double>")
    share = F.array(*(F.lit(float(e / trace)) for e in values)) if c else F.array().cast("array<double>")
    return out.select("row.*", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
