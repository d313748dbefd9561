"""A dictionary's fragments are cut out once, and those of one shape are written once."""

from pyspark.sql import functions as F

from graphloom.functions import penman
from graphloom.operators import dictionary, extraction
from graphloom.plans import taught
from tests.test_relational import DATA


def test_one_table_is_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(extraction.graphs, "cut", lambda df, whole=extraction.graphs.cut: written.append(df) or whole(df))
    assert taught.extracted_table(spark, DATA).count()
    assert len(written) == 1


def test_concepts_beside_the_counts(spark):
    """Equal fragments of different concepts count together by sentence, and apart in ``held``."""
    rows = [("p", "f", 1, ["a", "b"]), ("p", "f", 1, ["b", "a"]), ("p", "f", 2, ["a", "b"]), ("q", "f", 2, ["a", "b"]), (None, "f", 3, ["a"]), ("p", "g", 3, ["c"])]
    pairs = spark.createDataFrame(rows, "phrase string, frag string, sent long, concepts array<string>")
    for cap in (1, 2):
        told = dictionary.phrase_concept_counts(pairs, cap).withColumn("held", F.sort_array("held"))
        plain = dictionary.phrase_concept_counts(pairs.where("phrase is not null").drop("concepts"), cap)
        assert sorted(map(tuple, told.drop("held").collect())) == sorted(map(tuple, plain.collect()))
        held = {(r["phrase"], r["frag"]): [tuple(h) for h in r["held"]] for r in told.collect()}
        assert held == {("p", "f"): [(["a", "b"], 2), (["b", "a"], 1)], ("q", "f"): [(["a", "b"], 1)], ("p", "g"): [(["c"], 1)]}


def test_texts_by_shape():
    graph = penman.read("(o / order :item (p1 / part :flag a :of (q / part :flag a)) :item (p2 / part :flag a))")
    above = penman.parents(graph)
    extraction.shown.cache_clear()
    for ids in (["0.0", "0.0.0"], ["0.1", "0.1.0"], ["0.0.1", "0.0.1.0"]):
        assert extraction.fragment_text(graph, ids, above) == "(part :flag a)" == penman.show(penman.cut_out(graph, ids, above), 0)
    assert extraction.shown.cache_info().misses == 1
    for ids in (["0.0", "0.1"], ["0.0", "0.0"], ["9"], []):
        try:
            extraction.fragment_text(graph, ids, above)
            raise AssertionError(ids)
        except penman.PenmanError:
            pass
