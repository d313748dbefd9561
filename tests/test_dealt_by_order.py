"""Work by sentence stays where the sentence is: one exchange by order, nothing written for sentences of few nodes."""

import re

import pytest

from graphloom.operators import graphs
from graphloom.plans import queries
from tests.test_relational import DATA

TREE = [(1, "r", None, "0"), (1, "a", "r", "0"), (1, "b", "a", "1"), (1, "x", "y", "0"), (1, "y", "x", "0"), (1, "lost", "gone", "0"), (2, "r", None, "0"), (2, "a", "r", "0"), (2, "a", "r", "1")]


@pytest.mark.parametrize("name", ["tree_triples_1", "tree_triples_4", "cleared_edges", "disconnected_graphs", "unified_variables", "gorn_ids", "root_path", "lca_path_all", "preorder"])
def test_exchanges_by_order_alone(name, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"hashpartitioning\(([^)]*), [0-9]+\)", plan)
    assert keys and all(re.fullmatch("sent_id#[0-9]+L?", k) for k in keys), keys


def test_ways_in_a_row_and_over_tables(spark, monkeypatch):
    nodes = spark.createDataFrame(TREE + [(3, "n0", None, "0")] + [(3, f"n{k}", f"n{k - 1}", "0") for k in range(1, 100)], "sent_id long, node string, up string, own string")
    join = lambda above, own: graphs.F.concat(above, graphs.F.lit("."), own)
    want = sorted(map(tuple, graphs.climb_tables(nodes, join).collect()))
    rounds = []
    monkeypatch.setattr(graphs, "climb_tables", lambda df, join, whole=graphs.climb_tables: rounds.append({r[0] for r in df.select("sent_id").distinct().collect()}) or whole(df, join))
    assert sorted(map(tuple, graphs.climb(nodes, join).collect())) == want
    # Sentence 2 has a node twice, 3 more than a row takes.
    assert rounds == [{2, 3}]
    assert {r for r in want if r[0] == 1} == {(1, "r", "0"), (1, "a", "0.0"), (1, "b", "0.0.1")}


def test_fragments_in_a_row_and_by_level(spark):
    concepts = [(1, "r", "order"), (1, "a", "big"), (1, "b", "part"), (1, "x", "one"), (1, "y", "two"), (1, "z", None), (2, "r", "lone"), (3, "r", "top"), (3, "k", "kid")]
    edges = [(1, "r", ":mod", "a"), (1, "r", ":item", "b"), (1, "b", ":mod", "a"), (1, "x", ":m", "y"), (1, "y", ":m", "x"), (1, "b", ":nil", "z"), (3, "r", ":m", "k"), (3, "r", ":m", "gone")]
    n, e = spark.createDataFrame(concepts, "sent_id long, node_id string, concept string"), spark.createDataFrame(edges, "sent_id long, src string, label string, dst string")
    got = sorted(map(tuple, graphs.canonical_fragments(n, n, e).collect()), key=repr)
    assert got == sorted(map(tuple, graphs.fragments_by_level(n, e, n).collect()), key=repr)
    assert (1, "r", "(order :item (part :mod big :nil) :mod big)") in got and not [r for r in got if r[:2] in ((1, "x"), (3, "r"))]
