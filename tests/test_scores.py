"""Graph overlap on the bundled sample (fixed values), learning by batches and from where it stopped, graphs' ways."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import edgedecode, penman
from graphloom.operators import graphs, learning
from graphloom.sources import text as reader

SAMPLE = [
    ("(w / want-01 :ARG0 (b / boy) :ARG1 (b2 / believe-01 :ARG0 (g / girl) :ARG1 b))", "(w / want-01 :ARG0 (b / boy) :ARG1 (b2 / believe-01 :ARG0 (g / girl) :ARG1 (h / he)))", (8, 9, 10)),
    ("(p / person :domain (b / boy) :ARG0-of (w / work-01 :manner (h / hard)))", "(w / worker :mod (h / hard) :domain (b / boy))", (3, 8, 6)),
    *[('(b / bear-02 :ARG1 (p / poet :name (n / name :op1 "William" :op2 "Shakespeare")) :location (c / city :name (n2 / name :op1 "Stratford-upon-Avon")))',) * 2 + ((13, 13, 13),)],
]


def test_overlap_of_the_sample():
    found = [edgedecode.overlap(edgedecode.triples_of(penman.read(a)), edgedecode.triples_of(penman.read(b))) for a, b, _ in SAMPLE]
    assert found == [want for *_, want in SAMPLE]
    match, test, gold = (sum(x) for x in zip(*found))
    assert (match, test, gold) == (24, 30, 29) and round(2 * match / (test + gold), 2) == 0.81


def test_overlap_against_every_mapping():
    rnd = random.Random(5)
    for _ in range(60):
        a, b = (({k: rnd.choice("xyz") for k in range(n)}, [("v", k, rnd.choice("pq")) for k in range(n) if rnd.random() < 0.5], list({(rnd.choice("rs"), rnd.randrange(n), rnd.randrange(n)) for _ in range(n)})) for n in (rnd.randint(1, 4), rnd.randint(1, 4)))
        best = 0
        for order in set(permutations([*b[0], *[None] * len(a[0])], len(a[0]))):
            m = dict(zip(a[0], order))
            n = sum(a[0][i] == b[0].get(j) for i, j in m.items() if j is not None)
            n += sum(m[i] is not None and (name, m[i], v) in b[1] for name, i, v in a[1]) + sum(m[i] is not None and m[j] is not None and (r, m[i], m[j]) in b[2] for r, i, j in a[2])
            best = max(best, n)
        assert edgedecode.overlap(a, b, restarts=12)[0] == best


def vector(spark, values):
    return spark.createDataFrame([(k, None, float(v)) for k, v in values.items()], "feature string, label string, value double")


def read(df):
    return {r["feature"]: round(r["value"], 6) for r in df.collect()}


def test_batches_averages_and_warm_start(spark, tmp_path):
    gold = [vector(spark, {"a": 2, "b": 1}), vector(spark, {"c": 4})]
    told = [vector(spark, {"a": 1}), vector(spark, {"b": 2})]
    options = dict(passes=2, step=1.0, batches=2, batch_rows=2)
    decode = lambda w, cost, k: told[k]
    # A batch's step is a half: a pass adds (gold - told) / 2 of both batches.
    once = {"a": 0.5, "b": -0.5, "c": 2.0}
    assert read(learning.learn(decode, gold.__getitem__, learning.Options(**options))) == {k: 2 * v for k, v in once.items()}
    assert read(learning.learn(decode, gold.__getitem__, learning.Options(**options, average="sum"))) == {k: 3 * v for k, v in once.items()}
    assert read(learning.learn(decode, gold.__getitem__, learning.Options(**options, average="mean"))) == {k: 1.5 * v for k, v in once.items()}
    save, seen = str(tmp_path / "passes"), []
    stop = lambda p, w: bool(seen.append(p))
    first = learning.learn(decode, gold.__getitem__, learning.Options(**options), stop, save=save)
    assert read(first) == once and seen == [0]
    assert read(learning.learn(decode, gold.__getitem__, learning.Options(**options), save=save)) == {k: 2 * v for k, v in once.items()}


def test_unregularized_features(spark):
    same = vector(spark, {"a": 1})
    got = learning.learn(lambda w, cost: same, same, learning.Options(passes=1, step=0.5, l2=0.2, unregularized=("bias",)), start=vector(spark, {"a": 10, "bias": 10}))
    assert read(got) == {"a": 9.0, "bias": 10.0}


def test_ways_of_any_depth(spark):
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None) for i in range(300)] + [(2, "x", "gone"), (2, "y", "x"), (3, "p", "q"), (3, "q", "p"), (3, "r", None), (3, "s", "r")]
    got = {(r["sent_id"], r["node"]): r["path"] for r in graphs.ancestors(spark.createDataFrame(rows, "sent_id long, node string, parent string")).collect()}
    assert set(got) == {(1, f"n{i}") for i in range(300)} | {(3, "r"), (3, "s")}
    assert got[1, "n299"] == [f"n{i}" for i in range(299, -1, -1)] and got[3, "s"] == ["s", "r"]


def test_numbers_of_children_without_a_start(spark):
    edges = spark.createDataFrame([(1, "a", ":op", "x", 0), (1, "a", ":op", "y", 1), (1, "a", ":mod", "z", 2)], "sent_id long, src string, label string, dst string, ord int")
    starts = spark.createDataFrame([(1, "y", 4)], "sent_id long, dst string, start int")
    assert {(r["dst"], r["label"]) for r in graphs.number_ops(edges, starts).collect()} == {("y", ":op1"), ("x", ":op2"), ("z", ":mod")}


@pytest.mark.parametrize("tags, expected", [
    (["B-PER", "L-PER", "I-PER"], [(0, 3, "PER")]), (["B-PER", "B-PER", "O", "I-LOC"], [(0, 1, "PER"), (1, 2, "PER"), (3, 4, "LOC")]), (["U-ORG", "I-ORG", "I-PER"], [(0, 2, "ORG"), (2, 3, "PER")]), (["O"], []),
])
def test_entity_runs(spark, tags, expected):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "s long, run int, label string")
    assert sorted((r["start"], r["stop"], r["label"]) for r in reader.entities(df, "s", "run", "label").collect()) == expected


#: Date expressions and their fragments (F11, F12).
DATES = [
    ("021114", {"(date-entity :day 14 :month 11 :year 2002)", "(date-entity :day 14 :month 11 :year 02)"}), ("17 July 2003", {"(date-entity :day 17 :month 7 :year 2003)"}),
    ("July 2003", {"(date-entity :month 7 :year 2003)", "(date-entity :month 7)"}), ("July 18 , 2008", {"(date-entity :day 18 :month 7 :year 2008)", "(date-entity :month 7)"}), ("July 18 2008", {"(date-entity :day 18 :month 7 :year 2008)", "(date-entity :month 7)"}),
    ("2007-02-27", {"(date-entity :day 27 :month 2 :year 2007)"}), ("2007.02.27", {"(date-entity :day 27 :month 2 :year 2007)"}), ("1713", {"(date-entity :year 1713)"}), ("March", {"(date-entity :month 3)"}), ("sept. 2003", {"(date-entity :month 9 :year 2003)", "(date-entity :month 9)"}),
    ("170000", {"(date-entity :year 2017)", "(date-entity :day 0 :month 0 :year 17)"}), ("021100", {"(date-entity :month 11 :year 2002)", "(date-entity :day 0 :month 11 :year 02)"}),
]


def test_dates(spark):
    from graphloom.operators import candidates

    df = spark.createDataFrame([(i, t.replace(" ", "\t") + "\tand more") for i, (t, _) in enumerate(DATES)], "id int, tail string")
    got: dict = {}
    for r in candidates.date_candidates(df, "id", "tail").collect():
        got.setdefault(r["id"], set()).add(r["frag"])
    assert [got[i] for i in range(len(DATES))] == [want for _, want in DATES]
    assert candidates.date_candidates(df, "id", "tail").where(F.col("n_words") > 4).count() == 0
