"""Mixing against a plain allocation of seats, a plain water filling and the law of its blocks."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm.mixing import apportion, mix_sources, targets, word_count
from graphloom.llm.queries import op11_mixing


def highest_quotients(votes, seats):
    """One seat at a time to the highest votes / (2 k + 1), ties to the first."""
    quota = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        quota[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * quota[i] + 1), i))
    return quota


@pytest.mark.parametrize("seed", range(4))
def test_seats_go_to_the_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    groups = [([rnd.choice([0.0, 0.4, 1.0, 3.0, rnd.random() * 10 ** rnd.randint(0, 5)]) for _ in range(rnd.randint(1, 60))], rnd.choice([0, 1, 2, 7, 100, 5000])) for _ in range(12)]
    rows = [(g, i, v, s) for g, (votes, s) in enumerate(groups) for i, v in enumerate(votes)]
    got = {(r["g"], r["i"]): r["quota"] for r in apportion(spark.createDataFrame(rows, "g int, i int, votes double, seats long"), ["g"], "i").collect()}
    for g, (votes, s) in enumerate(groups):
        assert [got[g, i] for i in range(len(votes))] == highest_quotients(votes, s)


def shared_again(sizes, share, weights):
    """Share by weight, stop at the limit, share the rest again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        each = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * each >= 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * each for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_shared_again(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{k}": rnd.choice([0, 1, 10, 1000, rnd.randint(0, 10**6)]) for k in range(30)} | {None: 500, "\U0001f600": 7, "": 90}
    rows = [((s,), n) for s, n in sizes.items()]
    got = {r["src"]["source"]: r["target"] for r in targets(spark.createDataFrame(rows, "src struct<source:string>, source_size long"), 1.5, (3, 1, 2)).collect()}
    for s, t in shared_again(sizes, 1.5, (3, 1, 2)).items():
        assert math.isclose(got[s], t, rel_tol=1e-9)


def test_words_are_counted(spark):
    texts = [None, "", "  ", "a", " a b\t\x0bc\n", "x y z ", "\r\r"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [0, 0, 0, 1, 3, 2, 0]


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, taken string")
    return mix_sources(df, identity=["doc_id"], **more).collect()


def test_shares_and_odd_rows(spark):
    rnd = random.Random(5)
    # A third of all rows from one source, a very long row, null sources, ids and sizes, repeated rows.
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", rnd.randint(0, 400), "x") for i in range(3000)] + [(5000, "s1", 200_000, "x"), (None, None, 300, "x"), (None, None, 300, "x"), (7000, "s2", None, "x")] + [(6000, "s3", 40, "x")] * 50
    got = mixed(spark, rows)
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "source", "size", "source_size", "target", "taken"]
    totals: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        totals.setdefault(r["source"], []).append(r)
    assert math.isclose(sum(v[0]["target"] for v in totals.values()), 1.5 * sum(r["size"] for r in got))
    for s, v in totals.items():
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(4, 0.01 * v[0]["target"]), s
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows[::-1])))
    assert sorted(map(str, got)) != sorted(map(str, mixed(spark, rows, seed=12)))


def test_empty_tables_and_empty_texts(spark):
    assert mixed(spark, []) == []
    assert [(r["target"], r["taken"]) for r in mixed(spark, [(1, "a", 0, ""), (2, None, None, "")])] == [(0.0, 0)] * 2


def test_blocks_are_taken_evenly(spark):
    # One source takes 150 %: every word once or twice, and half of the blocks twice.
    got = mixed(spark, [(i, "a", 100, "") for i in range(2000)])
    assert all(100 <= r["taken"] <= 200 for r in got) and abs(sum(r["taken"] for r in got) - 300_000) <= 300
    assert 300 < sum(r["taken"] > 150 for r in got) < 1700


def test_query_is_native(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "x"), (2, None, None), (3, "d", "y")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = op11_mixing(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert {r["doc_id"]: r["size"] for r in df.collect()} == {1: 3, 2: 0, 3: 1}
