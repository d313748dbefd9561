from corpus_pipeline import line_dedup


def test_pipeline_cuts_long_passages_of_one_or_two_lines(spark):
    one = " ".join(f"one{i}" for i in range(51))
    two = " ".join(f"a{i}" for i in range(30)) + "\n" + " ".join(f"b{i}" for i in range(30))
    short = " ".join(f"s{i}" for i in range(50))
    rows = [(1, f"x1\n{one}\nx2\n{two}\nx3\n{short}\nx4"), (2, f"y1\n{one}\ny2"), (3, f"z1\n{two}\nz2"), (4, one), (5, f"v1\n{short}\nv2"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "y1\ny2", 3: "z1\nz2", 4: "", 5: rows[4][1], 6: None, 7: ""}
