"""Work that must not grow faster than what is read: steps counted or timed with wide margins, and exchanges of plans."""

import time

from pyspark.sql import functions as F

from graphloom.functions import align, edgedecode, penman
from graphloom.operators import edgefeatures
from graphloom.plans import rowsonly, taught
from tests.test_relational import DATA


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def chain(n, end):
    return edgedecode.triples_of(penman.read("".join(f"(c{i} :x " for i in range(n)) + end + ")" * n, gorn=False))


def test_overlap_of_long_chains():
    """Gains are kept, not reckoned anew for each move."""
    start = time.time()
    match, test, gold, mapping = edgedecode.best_mapping(chain(60, "(e / end)"), chain(60, "(e / end :polarity -)"))
    assert (match, test, gold) == (122, 122, 123) and all(i == j for i, j in mapping.items())
    assert time.time() - start < 20


def test_pairs_of_orders_share_one_exchange(spark):
    assert exchanges(rowsonly.smatch_pairs(spark, DATA)) == 1


def test_ways_by_shape(spark):
    """The ways told by a sentence's shape are those that are searched in its row, also where heads are broken or missing;
    equal shapes are searched once."""
    heads = [[-1, 0, 0, 1, 3], [1, -1, 9, 2, 4], [-1, None, 1, 0, 2], [-1, 0, 5, 5, -3], None]
    nodes = [("a", 0, 2), ("b", 1, 3), ("c", 3, 5), ("d", 4, 6)]
    df = spark.createDataFrame([(k, h, nodes) for k, h in enumerate(heads)], "k int, heads array<int>, nodes array<struct<id:string,start:int,stop:int>>")
    df = df.withColumn("__paths", edgefeatures.root_paths(F.col("heads")))
    fields = ("size", "w1", "w2", "up", "down")
    searched = F.transform("nodes", lambda a: F.transform(F.filter("nodes", lambda b: b["id"] != a["id"]), lambda b: edgefeatures.shortest(F.col("__paths"), a, b)))
    told = F.transform(edgefeatures.ways_by_shape(F.col("heads"), F.col("nodes")), lambda w: F.struct(*(w[x].alias(x) for x in fields)))
    for r in df.select(F.flatten(searched).alias("searched"), told.alias("told")).collect():
        assert r["searched"] == r["told"] and len(r["told"]) == 12
    edgefeatures.remembered.cache_clear()
    for _ in range(50):
        edgefeatures.remembered(((-1, 0), (0, 1), (1, 2)))
    assert edgefeatures.remembered.cache_info().misses == 1


def test_texts_are_made_once_a_pair():
    """What several features ask of a pair is a column of it: names of features do not spell it out again."""
    assert edgefeatures.asked(["dependencyPathv3", "dependencyPathv4", "posPathv1"]) == ["spelt3", "between", "context", "path3", "grams"]
    assert edgefeatures.asked(["bias"]) == []


def test_fragments_are_cut_out_before_the_table_is_put_together(spark):
    """The table is joined from counts that were taken once, not from fragments cut out anew for each of its features."""
    plan = taught.extracted_table(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


def test_lines_are_written_where_sentences_are(spark):
    """An order's graph and words come from one grouping, and no spans are dealt out."""
    assert exchanges(rowsonly.aligned_orders(spark, DATA)) == 1


def test_rules_look_once_at_a_concept():
    """Concepts that were seen are not matched again: 400 nodes of a few concepts took a match for each rule and node."""
    graph = penman.read("(o / order" + "".join(f" :item (p{k} / part-{k % 7} :flag a)" for k in range(200)) + ")")
    align.applies.cache_clear(), align.looks.cache_clear()
    align.align(["The", "order"] + ["part", "a"] * 200, graph)
    assert align.applies.cache_info().misses < 100 and align.looks.cache_info().misses < 300


def test_edges_of_orders_are_dealt_out_once(spark):
    """The decoders' edges, gathered beside the lines, are those of the joined table."""
    df = rowsonly.order_edges(spark, DATA)
    assert exchanges(df) == 1
    told = sorted((r["sent_id"], tuple(map(tuple, r["edges"]))) for r in df.collect())
    joined = rowsonly.decoder_input(spark, DATA).groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "label", "score"))).alias("edges"))
    assert told == sorted((r["sent_id"], tuple(map(tuple, r["edges"]))) for r in joined.collect())
