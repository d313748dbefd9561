import glob
import os

import duckdb
import pytest

from graphloom.functions import edgedecode, penman
from graphloom.operators import decoding, edgefeatures
from graphloom.plans import stage2, tools
from tests.test_relational import DATA, plain


QUERIES, ORACLE = stage2.QUERIES | tools.QUERIES, stage2.ORACLE | tools.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(name, spark):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_unknown_and_new_features(spark):
    with pytest.raises(ValueError, match="unknown stage-2 features"):
        edgefeatures.edge_features(stage2.order_sentences(spark, DATA), ("guess",))
    edgefeatures.edge_feature("both")(lambda p: edgefeatures.F.array(edgefeatures.item(edgefeatures.text("both=", p.a["id"], p.b["id"]), 1, 0)))
    try:
        assert edgefeatures.edge_features(stage2.order_sentences(spark, DATA), ("both",)).where("feature = 'both=n0n1'").count()
    finally:
        del edgefeatures.EDGE["both"]


def test_scores_of_labels_and_groups(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b")], "sent_id long, node_id string")
    labels = spark.createDataFrame([(":ARG0",), (":mod",)], "label string")
    f = spark.createDataFrame([(1, "a", "b", "x", 2.0, 3.0, None), (1, "a", "b", "g", 0.0, 0.0, "ARG"), (1, "a", "b", "h", 0.0, 0.0, "other")], "sent_id long, src string, dst string, feature string, u double, c double, labels string")
    w = spark.createDataFrame([("x", None, 10.0), ("x", ":mod", 1.0), ("g", None, 0.5), ("h", None, 0.25)], "feature string, label string, value double")
    got = {(r["src"], r["label"]): r["score"] for r in decoding.pair_scores(nodes, labels, f, w).collect()}
    assert got == {("a", ":ARG0"): 20.5, ("a", ":mod"): 23.25, ("b", ":ARG0"): 0.0, ("b", ":mod"): 0.0}


def every_pair(n, given, label=":r"):
    return [(a, b, label, given.get((a, b), 0.0)) for a in range(1, n + 1) for b in range(1, n + 1) if a != b]


def test_toys():
    """The two decoder toys (F15, F16)."""
    a = every_pair(3, {(1, 2): 6.0, (2, 3): -6.0, (1, 3): 3.0})
    assert {e[:2] for e in edgedecode.connected_subgraph([1, 2, 3], [], a)} == {(1, 2), (1, 3)}
    assert {e[:2] for e in edgedecode.top_labels([1, 2, 3], [], a, {":r": 1})} == {(1, 2)}
    b = every_pair(4, {(1, 2): 6.0, (2, 3): -6.0, (1, 3): 0.0})
    out = edgedecode.connected_subgraph([1, 2, 3, 4], [(3, 4, ":r", 0.0)], b)
    sets = edgedecode.Sets([1, 2, 3, 4])
    for e in out:
        sets.join(*e[:2])
    assert len(out) == 3 and sets.n == 1 and {(1, 2), (3, 4)} <= {e[:2] for e in out}


def test_relaxation_rules():
    scores = every_pair(3, {(1, 2): 6.0, (1, 3): 3.0})
    for strategy in edgedecode.STEPS:
        out, good = edgedecode.relaxed([1, 2, 3], [], scores, {":r": 1}, strategy=strategy)
        assert not good or all(sum(e[0] == n for e in out) <= 1 for n in (1, 2, 3))
    assert edgedecode.relaxed([1, 2, 3], [], scores, {":r": 0}, iterations=2, fallback=lambda *a: ["fallback"]) == (["fallback"], False)
    with pytest.raises(ValueError):
        edgedecode.relaxed([1], [], [], {}, strategy="guess")
    assert edgedecode.largest_weight(scores) == 6.0 and edgedecode.largest_weight([]) == 1.0


def test_and_root_and_costs():
    assert edgedecode.with_and_root([1, 2, 3], [(1, 2, ":r", 1.0)], {2: 5.0}) == ("and", [(1, 2, ":r", 1.0), ("and", 2, ":op", 0.0), ("and", 3, ":op", 0.0)])
    assert edgedecode.with_and_root([1, 2], [(1, 2, ":r", 1.0)], {})[0] == 1
    scores = every_pair(2, {(1, 2): 1.0, (2, 1): 0.5})
    decode = lambda nodes, fixed, s, limits: edgedecode.connected_subgraph(nodes, fixed, s)
    near = edgedecode.cost_augmented(decode, [1, 2], [], scores, {}, {1: "x", 2: "y"}, {("y", ":r", "x")}, -1e11)
    far = edgedecode.cost_augmented(decode, [1, 2], [], scores, {}, {1: "x", 2: "y"}, {("y", ":r", "x")}, 1.0)
    assert near == [(2, 1, ":r", 0.5)] and (1, 2, ":r", 1.0) in far


def test_spanning_tree_and_names():
    edges = [("a", ":x", "b"), ("c", ":y", "a"), ("b", ":z", "c"), ("b", ":a", "d")]
    tree, again = penman.spanning_tree("a", edges)
    assert tree == [("a", ":x", "b"), ("b", ":a", "d"), ("b", ":z", "c")] and again == [("c", ":y", "a")]
    # The price of going backwards is that edge's alone: what hangs below stays near.
    tree, _ = penman.spanning_tree("a", [("b", ":r", "a"), ("b", ":s", "c"), ("d", ":t", "a")])
    assert tree == [("a", ":r-of", "b"), ("b", ":s", "c"), ("a", ":t-of", "d")]
    assert penman.name_apart(["a", "b", "a", None, "a2", "a"]) == ["a", "b", "a2", None, "a3", "a4"]
    assert penman.numbered_ops([(":op", "x"), (":mod", "m"), (":op", "y"), (":op", "z")], {"x": 5, "y": 2}) == [(":op1", "y"), (":op2", "x"), (":op3", "z"), (":mod", "m")]
