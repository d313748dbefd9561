import random

from pyspark.sql import functions as F

from corpus_pipeline import near_dedup
from graphloom.llm import nearcopies


def texts():
    rnd = random.Random(3)
    out = []
    for _ in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((4, 12, 60, 120)))]
        out.append(" ".join(words))
        for edits in (1, 2, 3, 4):
            other = list(words)
            for _ in range(edits):
                other[rnd.randrange(len(other))] = f"x{rnd.randrange(5000)}"
            out.append(" ".join(other))
    return [*out, "", None, " . "]


def least_of_groups(all_texts):
    """Brute force: the least index of each text's group."""
    sets = [set(nearcopies.shingles(t, 5).tolist()) for t in all_texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    return group


def test_all_pairs_of_a_similarity_of_four_fifths_are_linked(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["key"]: r["component_id"] for r in nearcopies.near_copies(df, key=F.col("doc_id")).collect()}
    assert [got[i] for i in range(len(rows))] == least_of_groups(rows)


def test_pipeline_drops_near_copies_that_differ_in_many_bits(spark):
    words = [f"w{i}" for i in range(64)]
    other = [*words[:20], "other", *words[21:]]
    assert len(set(words)) == 64
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "something else entirely is written here")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup(spark, df, "").collect()) == [1, 3]
