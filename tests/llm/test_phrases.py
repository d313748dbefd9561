"""Collocations against plain counting, the parts of the machine, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import phrases
from graphloom.llm.phrases import collocations

DOCS = "doc_id long, text string, lang string, phrase string"


def plainly(rows, least, top, inside=100):
    by: dict = {}
    for _, text, lang, _ in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            f = by.setdefault(lang or "und", [Counter(), 0])
            f[1] += len(ws)
            for m in range(1, 6):
                f[0].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, (f, n) in by.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {}
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held.get(p[i : i + m], 0), a)
        best = []
        for p, a in found.items():
            if 100 * held.get(p, 0) >= inside * a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        out += [(lang, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y, n) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["a", "b", "C", "É", "d e", "x\x00", "the", "\U0001f600"] + [f"w{k}" for k in range(30)]
    say = lambda: "".join(rnd.choice(words[: rnd.choice([3, 8, 38])]) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(rnd.randint(0, 60)))
    return [(i, say(), rnd.choice(["en", "en", "de", None, "und"]), "p") for i in range(n)]


@pytest.mark.parametrize("seed, least, inside", [(1, 3, 100), (2, 5, 60), (3, 1, 100)])
def test_equal_to_plain_counting(spark, monkeypatch, seed, least, inside):
    # Small chunks and many ranges, so that runs go over the ranges' edges.
    monkeypatch.setattr(phrases, "RANGES", 300)
    rows = texts(seed, 150) + [(900, None, "en", "p"), (901, "", "xx", "p")] + [(902, "same words here again and more " * 3, "en", "p")] * 20
    got = collocations(spark.createDataFrame(rows, DOCS), least=least, top=200, inside=inside)
    assert sorted(map(tuple, got.collect())) == plainly(rows, least, 200, inside)


def test_long_texts_without_breaks(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(1, " ".join(rnd.choice("abcdefgh") for _ in range(40_000)), "en", ""), (2, "z" * 3_000_000 + " a b", "en", "")]
    assert sorted(map(tuple, collocations(spark.createDataFrame(rows, DOCS), least=100).collect())) == plainly(rows, 100, 2000)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, None)], DOCS)).collect() == []


@pytest.mark.parametrize("digits", [1, 2])
def test_radix_and_runs(digits):
    rnd = np.random.default_rng(6)
    ids = rnd.integers(0, 5, 5000) * (65_537 if digits == 2 else 1)
    keys = phrases.windows(ids.astype(np.uint32), 0, len(ids), 5, digits)
    found, counts = phrases.counted(keys)
    plain = Counter(map(tuple, keys.T.tolist()))
    assert [tuple(k) for k in found.T.tolist()] == sorted(plain) and counts.tolist() == [plain[k] for k in sorted(plain)]
    assert (np.diff(np.searchsorted(phrases.as_bytes(found), phrases.as_bytes(found))) == 1).all()
    halves = [phrases.windows(ids.astype(np.uint32), a, b, 5, digits) for a, b in ((0, 1234), (1234, 5000))]
    assert (np.concatenate(halves, axis=1) == keys).all()


def test_products_past_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, l, r = 4 * 10**9, 9 * 10**14, 5 * 10**9, 6 * 10**9
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    got = df.select((whole("a") * (whole("n") * 1000).cast("decimal(19,0)")).alias("over"), (whole("l") * whole("r")).alias("under")).select(F.expr("over div under")).first()[0]
    assert got == 1000 * a * n // (l * r)
