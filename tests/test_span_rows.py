"""Covers in the sentence's row are those of the tables."""

import random
import re

import pyarrow as pa
import pytest

from graphloom.functions import spans
from graphloom.operators import decoding
from graphloom.plans import queries
from tests.test_relational import DATA

FEATURE = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64())]))


def test_cover_in_a_row_and_over_tables(spark):
    r = random.Random(3)
    weights = {"a": 0.5, "b": -1.0, "c": 0.25}
    sents = []
    for _ in range(60):
        places = {(s, s + r.randint(1, 3), r.choice(["x", "y", "é", "z", "~"])) for s in (r.randint(0, 9) for _ in range(r.randint(0, 12)))}
        sents.append([(*c, [{"feature": f, "value": float(r.randint(-1, 2))} for f in r.choices(["a", "b", "c", "none", None], k=r.randint(0, 3))]) for c in sorted(places)])
    column = lambda i, kind: pa.array([[c[i] for c in cs] for cs in sents], pa.list_(kind))
    got = spans.best_cover(column(0, pa.int32()), column(1, pa.int32()), column(2, pa.string()), column(3, FEATURE), weights).to_pylist()
    score = lambda c: float(sum(weights.get(f["feature"], 0.0) * f["value"] for f in c[3]))
    table = spark.createDataFrame([(i, *c[:3], score(c)) for i, cs in enumerate(sents) for c in cs], "sent_id long, start int, stop int, frag string, score double")
    want = sorted(map(tuple, decoding.cover(decoding.chart(table)).collect()))
    assert sorted((i, *sents[i][x["k"]][:3], x["score"]) for i, xs in enumerate(got) for x in xs) == want
    assert sorted(map(tuple, decoding.best_spans(table).collect())) == want


@pytest.mark.parametrize("name", ["parse_cover", "chart_decode"])
def test_one_exchange_of_candidates(name, spark):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    keys = [k for k in re.findall(r"hashpartitioning\(([^)]*), [0-9]+\)", plan) if "sent_id" in k]
    assert len(keys) == 1 and "stop" not in keys[0], keys


def test_gold_and_matches_in_a_row():
    start, stop, frag = pa.array([[0, 0, 1], [], [0]], pa.list_(pa.int32())), pa.array([[1, 1, 3], [], [1]], pa.list_(pa.int32())), pa.array([["x", None, "y"], [], ["x"]])
    gold = pa.array([[{"start": 1, "stop": 3, "frag": "y"}, {"start": 0, "stop": 1, "frag": None}], [], [{"start": 0, "stop": 1, "frag": "y"}]])
    assert spans.asked_for(start, stop, frag, gold).to_pylist() == [[2], [], []]
    entries = pa.array([{"frag": "one"}, {"frag": "two"}, {"frag": "other"}])
    found = spans.matches(pa.array([["a", "b", "a"], [], None, ["b"]]), [1, 2], entries, {"a": [0], "a b": [1, 2]})
    assert [[tuple(x.values()) for x in row] for row in found.to_pylist()] == [[(0, "one"), (2, "one"), (0, "two"), (0, "other")], [], [], []]
