import os

import duckdb
import pytest

from graphloom.functions import edgedecode, penman
from graphloom.operators import decoding
from graphloom.plans import inputs, queries, rowsonly

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def twin(name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return sorted(con.execute(queries.ORACLE[name]).fetchall())


def test_graphs_and_overlap_of_all_orders(spark):
    texts = {r["sent_id"]: r["penman"] for r in rowsonly.order_graphs(spark, SF).collect()}
    assert set(texts) == {r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    pairs = sorted(tuple(r) for r in rowsonly.smatch_pairs(spark, SF).collect())
    graph = {k: edgedecode.triples_of(penman.read(t)) for k, t in texts.items()}
    assert pairs == [(k // 2, *edgedecode.overlap(graph[k], graph[k + 1])) for k in sorted(graph) if k % 2 == 0 and k + 1 in graph]


def test_pool_of_all_orders(spark):
    assert sorted(tuple(r) for r in queries.smatch_pool_all(spark, SF).collect()) == twin("smatch_pool_all")


def test_common_paths_of_all_nodes(spark):
    got = sorted(tuple(r) for r in queries.lca_path_all(spark, SF).collect())
    assert got == twin("lca_path_all")
    assert len(got) == queries.root_paths(spark, SF).count() - inputs.order_lines(spark, SF).select("sent_id").distinct().count()


def test_more_labels_than_ten_thousand(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b")], "sent_id long, node_id string")
    labels = spark.range(10_001).selectExpr("cast(id as string) as label")
    features = spark.createDataFrame([], "sent_id long, src string, dst string, feature string, u double, c double")
    weights = spark.createDataFrame([], "feature string, label string, value double")
    assert decoding.pair_scores(nodes, labels, features, weights).count() == 2 * 10_001


def test_relaxation_says_whether_limits_hold(spark):
    scored = {}
    for r in rowsonly.decoder_input(spark, SF).collect():
        scored.setdefault(r["sent_id"], []).append((r["src"], r["dst"], r["label"], r["score"]))
    want = []
    for sent, edges in scored.items():
        edges.sort()
        out, holds = edgedecode.relaxed(sorted({x for e in edges for x in e[:2]}), [], edges, rowsonly.LIMITS, strategy="sqrtT")
        want += [(sent, *e, holds) for e in out]
    assert sorted(tuple(r) for r in rowsonly.relaxation(spark, SF).collect()) == sorted(want)
