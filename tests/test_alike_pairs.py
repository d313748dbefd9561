"""Pairs that are alike in what features look at have their features made once, with the totals of all pairs."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import edgefeatures
from graphloom.plans import stage2
from tests.test_relational import DATA

TAGS = ("posPathv1", "posPathv2", "posPathv3")


def test_what_features_look_at(spark):
    assert edgefeatures.alike(TAGS) == ["between", "context", "path3"]
    assert edgefeatures.alike(["posPathv2"]) == ["context", "grams"]
    assert edgefeatures.alike([*TAGS, "bias"]) == ["between", "context", "path3"]
    assert edgefeatures.alike(["bias"]) == edgefeatures.alike(["distance"]) == edgefeatures.alike(["dependencyPathv4"]) == []


@pytest.mark.parametrize("names", [TAGS, (*TAGS, "dependencyPathv5", "bias")])
def test_totals_are_those_of_all_pairs(spark, names):
    s = stage2.order_sentences(spark, DATA).where("sent_id % 8 = 1")
    plain = edgefeatures.edge_features(s, names).groupBy("feature", "labels").agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("c").alias("c"))
    assert sorted(map(tuple, edgefeatures.feature_totals(s, names).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_ways_are_spelt_from_steps(spark):
    """The text from the steps of words is that of the way itself, also where heads are broken or missing."""
    heads = [[-1, 0, 0, 1, 3], [1, -1, 9, 2, 4], [-1, None, 1, 0, 2], [-1, 0, 5, 5, -3]]
    rows = [(k, h, ["A", "B", None, "D", "E"], ["r0", "r1", "r2", None, "r4"]) for k, h in enumerate(heads)]
    df = spark.createDataFrame(rows, "k int, heads array<int>, tags array<string>, rels array<string>")
    ups, downs = edgefeatures.steps(F.col("heads"), F.col("rels"), F.col("tags"))
    df = df.withColumns({"__up3": ups, "__down3": downs, "paths": edgefeatures.root_paths(F.col("heads"))})
    df = df.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(4))))
    df = df.withColumn("way", edgefeatures.dependency_path(F.col("paths"), F.col("a"), F.col("b")))
    spelt = edgefeatures.Pair(lambda x: F.col(x)).spelt("3")
    found = df.select(spelt.alias("x"), edgefeatures.path_text(F.col("way.up"), F.col("way.down"), F.col("rels"), F.col("tags")).alias("y")).collect()
    assert len(found) == 100 and all(r["x"] == r["y"] for r in found)
