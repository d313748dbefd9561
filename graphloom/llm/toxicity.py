"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 not toxic, 1 toxic with few different marks, 2 toxic with many. P(grade > j) = s(w.x - t_j) with one
weight vector for all thresholds t_0 <= t_1. The output is the expected grade, the probability of each grade and
whether a text is toxic (P(grade > 0) at ``TOXIC_AT`` or more).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import without

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that the model is fitted on, at most about: a sample by hash of their ids.
SAMPLE_ROWS = 20_000
#: Lengths of the word beginnings that are features; passes, step and shrinkage of the fit.
PREFIXES, PASSES, STEP, SHRINK = (3, 4, 5, 6), 600, 0.1, 0.01
#: Features are kept whose likelihood ratio against the toxic label is so high (far beyond chance among a million).
EVIDENCE = 28.0
#: Words of which a worker remembers what they add; emptied when full, which changes no result.
MEMO = 300_000
GRADES = 3
#: Probability of any toxic grade from which a text counts as toxic: one strong mark reaches it.
TOXIC_AT = 0.35


def features(text: str | None) -> dict[str, int]:
    """Words and word beginnings with their counts."""
    found: dict[str, int] = {}
    for w in WORD.findall((text or "").lower()):
        found[w] = found.get(w, 0) + 1
    starts: dict[str, int] = {}
    for w, n in found.items():
        for k in PREFIXES:
            if len(w) > k:
                starts["^" + w[:k]] = starts.get("^" + w[:k], 0) + n
    return found | starts


def squash(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def __post_init__(self):
        self.memo: dict[str, tuple] = {}

    def effect(self, word: str) -> tuple:
        """The features of a word that have a weight."""
        found = self.memo.get(word)
        if found is None:
            names = [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]
            found = tuple(x for x in names if x in self.weights)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def grades(self, text: str | None) -> list[float]:
        """The probability of each grade."""
        words = set(WORD.findall((text or "").lower()))
        z = sum(map(self.weights.__getitem__, sorted({x for w in words for x in self.effect(w)})))
        above = [1.0, *(float(squash(z - t)) for t in self.thresholds), 0.0]
        return [above[j] - above[j + 1] for j in range(len(above) - 1)]


def evidence(bad: str, seen: str, all_bad: int, rows: int) -> str:
    """SQL for G squared of a feature's presence (``bad`` toxic rows of ``seen``) against the label."""

    def term(have: str, expected: str) -> str:
        return f"if({have} > 0, {have} * ln({have} / ({expected})), 0D)"

    good, all_good = f"({seen} - {bad})", rows - all_bad
    without = f"({rows}D - {seen})"
    return "2 * (" + " + ".join([
        term(f"double({bad})", f"{seen} * {all_bad}D / {rows}"), term(f"double{good}", f"{seen} * {all_good}D / {rows}"),
        term(f"({all_bad}D - {bad})", f"{without} * {all_bad} / {rows}"), term(f"({all_good}D - {good})", f"{without} * {all_good} / {rows}"),
    ]) + ")"


def fit(names: list[list[str]], grades: np.ndarray, times: np.ndarray, grades_n: int = GRADES) -> Model:
    """Weights of the greatest penalised likelihood of the grades; presence of a feature is its value."""
    index: dict[str, int] = {}
    rows = [np.array(sorted({index.setdefault(x, len(index)) for x in r}), dtype=np.int64) for r in names]
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate([np.zeros(0, np.int64), *rows])
    # Thresholds are kept in order as a first one and steps above it, whose logarithms are free.
    free = np.concatenate([np.zeros(len(index)), [1.0], np.zeros(grades_n - 2)])
    first, second = np.zeros_like(free), np.zeros_like(free)
    here = np.arange(len(rows))
    for step in range(1, PASSES + 1):
        w, gaps = free[: len(index)], np.exp(free[len(index) + 1 :])
        t = free[len(index)] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(of, w[at], minlength=len(rows))
        above = np.concatenate([np.ones((len(rows), 1)), squash(z[:, None] - t), np.zeros((len(rows), 1))], axis=1)
        slope = above * (1 - above)
        p = np.maximum(1e-9, above[here, grades] - above[here, grades + 1])
        upper, lower = times * slope[here, grades] / p, times * slope[here, grades + 1] / p
        by_t = np.bincount(grades, -upper, minlength=grades_n + 1)[1:grades_n] + np.bincount(grades + 1, lower, minlength=grades_n + 1)[1:grades_n]
        tails = np.cumsum(by_t[::-1])[::-1]
        g = np.concatenate([np.bincount(at, (upper - lower)[of], minlength=len(index)) - SHRINK * w, [tails[0]], tails[1:] * gaps])
        # Adam on the whole sample: every row counts in every step, so the order of rows does not matter.
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        free = free + STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    w, t = free[: len(index)], free[len(index)] + np.concatenate([[0.0], np.cumsum(np.exp(free[len(index) + 1 :]))])
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    back = list(index)
    return Model({back[k]: float(w[k]) for k in keep}, tuple(float(x) for x in t))


def train(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model fitted on a sample by hash of about ``sample_rows`` of the labelled rows.

    Rows with a null id, text or label are left out; repeated rows count as often as they occur. A toxic row's
    grade is 2 if it has more different marks than the median toxic row, else 1; marks are features with
    evidence that are commoner in toxic texts. Without toxic rows everything has grade 0.
    """
    known = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # The sample is bounded, so it goes to the documents; one id with very many labels would break that bound.
    if known.limit(4 * sample_rows + 1).count() <= 4 * sample_rows:
        known = F.broadcast(known)
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(known, "id").where("text is not null")

    rows = rows.select("text", "toxic")
    n_all, n_bad = rows.agg(F.count("*"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).first()  # two numbers
    if not n_bad or n_bad == n_all:
        return Model({}, (10.0, 20.0))

    def count(batches):
        held: dict[str, list[int]] = {}

        def out():
            names = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[x][0] for x in names], pa.int64()), pa.array([held[x][1] for x in names], pa.int64())], names=["name", "bad", "seen"])
            held.clear()

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in features(t):
                    n = held.setdefault(x, [0, 0])
                    n[0] += y > 0
                    n[1] += 1
                if len(held) > 200_000:
                    yield from out()
        yield from out()

    # Features without clear evidence are left out: a long text has so many of them that their chance weights
    # would add up to more than the words that matter. They are counted and chosen where the rows are; those that
    # come to the driver are all with evidence, whose number is bounded by the sample.
    counted = rows.mapInArrow(count, "name string, bad long, seen long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    strong = counted.where(F.expr(evidence("bad", "seen", n_bad, n_all)) >= EVIDENCE).orderBy("name").collect()
    kept = {r["name"]: r["bad"] * n_all > r["seen"] * n_bad for r in strong}
    shared = docs.sparkSession.sparkContext.broadcast(set(kept))

    def read(batches):
        for batch in batches:
            found = [sorted(shared.value.intersection(features(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["toxic", "names"])

    got = rows.mapInArrow(read, "toxic int, names array<string>").groupBy("toxic", "names").agg(F.count("*").alias("n")).collect()
    got = sorted(((r["toxic"] > 0, list(r["names"]), r["n"]) for r in got), key=lambda r: (r[0], r[1]))
    names, times = [r[1] for r in got], np.array([r[2] for r in got], dtype=float)
    bad = np.array([r[0] for r in got], dtype=bool)
    marks = np.array([sum(kept[x] for x in r) for r in names])
    grades = np.where(bad, np.where(marks > np.median(np.repeat(marks[bad], times[bad].astype(int))), 2, 1), 0)
    return fit(names, grades, times)


def grade_toxicity(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``df`` with ``severity`` (expected grade, 0 to 2), ``p_toxic`` (0 to 1) and ``toxic``.

    A null or empty text has no features, so its severity is the thresholds' own, near 0, and it is not toxic.
    Whole texts are read; repeated rows and nulls elsewhere pass through, and columns named as an output are
    replaced. The model is broadcast; its size is bounded by the sample it was fitted on.
    """
    kept = without(df, ("severity", "p_toxic", "toxic"))
    source = df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text}`"].cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "severity double, p_toxic double, toxic boolean"])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.grades(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            severity = [sum(j * p for j, p in enumerate(f)) for f in found]
            p = [1.0 - f[0] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(severity, pa.float64()), pa.array(p, pa.float64()), pa.array([x >= TOXIC_AT for x in p], pa.bool_())], names=[*batch.schema.names[:-1], "severity", "p_toxic", "toxic"])

    return source.mapInArrow(run, schema)
