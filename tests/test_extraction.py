"""Fragments cut out by ids, dictionaries, stems, the older aligner, and reports of what does not match."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import edgedecode, penman, wordalign
from graphloom.operators import evaluation, extraction, parsing, stemming

TEXT = "(p / person :ARG0-of (h / have-org-role-91 :ARG2 (m / minister) :ARG1 (c / country :name (n / name :op1 \"Iran\"))) :mod p2 :op2 (q / x :y p))"


@pytest.mark.parametrize("ids, expected", [
    (["0"], "person"), (["0", "0.0", "0.0.0"], "(person :ARG0-of (have-org-role-91 :ARG2 minister))"), (["0.0", "0.0.0", "0.0.1", "0.0.1.0", "0.0.1.0.0"], '(have-org-role-91 :ARG1 (country :name (name :op1 "Iran")) :ARG2 minister)'),
    (["0", "0.0", "0.1"], "(person :ARG0-of have-org-role-91 :mod p2)"), (["0", "0.2"], "(person :op2 x)"),
])
def test_fragments_by_ids(ids, expected):
    assert penman.show(penman.cut_out(penman.read(TEXT), ids), 0) == expected


@pytest.mark.parametrize("ids", [[], ["9"], ["0", "0.0.0"], ["0.0", "0"], ["0", "0.0", "0.1", "0.0.0"], ["0", "0"]])
def test_fragments_that_fall_apart(ids):
    with pytest.raises(penman.PenmanError):
        penman.cut_out(penman.read(TEXT), ids)


def test_table_from_blocks(spark, tmp_path):
    words = "the minister of Iran met the minister".split()
    rows = [
        (1, words, "(m / meet-03 :ARG0 (x / minister :mod (c / country :name (n / name :op1 \"Iran\"))) :ARG1 (y / minister))", "4-5|0 1-2|0.0 3-4|0.0.0+0.0.0.0+0.0.0.0.0 6-7|0.1 0-9|0 2-2|0 x|0 *1-2|0.0+0.1"),
        (2, ["minister"], "(m / minister)", "0-1|0"), (3, ["minister"], "(m / mayor)", "0-1|0"), (4, ["a"], "(m / ", "0-1|0"), (5, None, "(a / b)", None), (6, ["minister"], None, "0-1|0"),
    ]
    blocks = spark.createDataFrame(rows, "sent_id long, words array<string>, penman string, alignments string")
    spans = extraction.span_fragments(blocks).cache()
    got = {(r["sent_id"], r["span_id"]): r for r in spans.collect()}
    assert got[1, 2]["frag"] == '(country :name (name :op1 "Iran"))' and got[1, 2]["phrase"] == "Iran" and got[1, 2]["concepts"] == ["country", "name", '"Iran"']
    assert {k for k, r in got.items() if r["error"]} == {(1, 4), (1, 5), (1, 6), (1, 7), (4, None), (6, None)} and got[1, 7]["coref"] and got[1, 7]["frag"] is None
    table = extraction.concept_table(spans, blocks.select("sent_id", F.coalesce("words", F.array().cast("array<string>")).alias("words")), tuple(extraction.FEATURES), most=1)
    t = {(" ".join(r["words"]), r["frag"]): r for r in table.collect()}
    two = t["minister", "minister"]
    # Two spans in sentence 1 and one in sentence 2: two sentences are over the limit of one.
    assert two["features"]["N"] == 3.0 and two["indices"] == [] and t["minister", "mayor"]["indices"] == [3]
    # Five places have the word, and each counts for both entries.
    assert two["features"]["c|p"] == pytest.approx(math.log(3 / 10)) and two["features"]["p|c"] == 0.0
    assert t["Iran", '(country :name (name :op "Iran"))']["features"]["logPrConcept"] == pytest.approx(3 * math.log(1 / 8))
    lines = table.select(extraction.concept_line(F.col("words"), F.col("frag"), F.col("features"), F.col("indices")).alias("value"))
    lines.write.text(str(tmp_path / "t"))
    from graphloom.options import Settings, Stage1

    known = parsing.Knowledge.load(spark, Settings(Stage1(concept_table=str(tmp_path / "t"))))
    back = {(" ".join(r["words"]), r["frag"]): r for r in known.dictionary.collect()}
    assert back.keys() == t.keys() and back["minister", "mayor"]["features"]["N"] == 1.0 and back["minister", "mayor"]["indices"] == [3]
    with pytest.raises(ValueError, match="unknown features"):
        extraction.concept_table(spans, blocks, ("guess",))


def test_stems_by_part_of_speech(spark):
    words = spark.createDataFrame([(w,) for w in ("Boxes", "boxes", "running", "went", "ties", "bigger", "women", "s", None, "xyz")], "surface string")
    lexicon = spark.createDataFrame([("box", "noun"), ("box", "verb"), ("run", "verb"), ("runn", "verb"), ("go", "verb"), ("went", "noun"), ("tie", "noun"), ("tie", "verb"), ("ty", "noun"), ("big", "adj"), ("woman", "noun")], "stem string, pos string")
    odd = spark.createDataFrame([("went", "verb", "go"), ("bigger", "adj", "big"), ("ties", "noun", "tie")], "surface string, pos string, stem string")
    got = {tuple(r) for r in stemming.stems(words, lexicon, odd).collect()}
    # Of ties, the irregular noun stands in place of the regular ones; the verb is regular.
    assert got == {("Boxes", "noun", "box"), ("boxes", "noun", "box"), ("Boxes", "verb", "box"), ("boxes", "verb", "box"), ("running", "verb", "runn"), ("went", "verb", "go"), ("went", "noun", "went"), ("ties", "noun", "tie"), ("ties", "verb", "tie"), ("bigger", "adj", "big"), ("women", "noun", "woman")}
    # In a parse, a word has the stems of its tag's part of speech.
    places = spark.createDataFrame([(1, 0, "boxes", "VBZ"), (1, 1, "ties", "NNS"), (1, 2, "women", "XX")], "sent_id long, start int, word string, tag string")
    known = parsing.Knowledge(stems=stemming.stems(words, lexicon, odd))
    assert {tuple(r) for r in parsing.from_source("verbs", places, known).collect()} == {(1, 0, "boxes", "box-00")}
    assert {r["frag"] for r in parsing.from_source("WordNetPassThrough", places, known).collect()} == {"box", "tie"}
    assert stemming.stems(words.where("false"), lexicon).count() == 0


def test_older_aligner():
    graph = penman.read('(s / say-01 :ARG0 (p / person :name (n / name :op1 "Anna" :op2 "Berg")) :ARG1 (g / government :mod (o / old)) :time (d / date-entity :year 2002))')
    stems = [["Anna"], ["Berg"], ["said", "say"], ["the"], ["governments"], ["2002"], ["old"]]
    of = wordalign.align_words(stems, graph)
    assert of == {"0": 2, "0.0.0.0": 0, "0.0.0.1": 1, "0.1": 4, "0.1.0": 6, "0.2.0": 5}
    spans = wordalign.align_spans(len(stems), graph, of)
    assert spans == [(2, 3, ["0"]), (0, 2, ["0.0", "0.0.0", "0.0.0.0", "0.0.0.1"]), (4, 5, ["0.1"]), (6, 7, ["0.1.0"]), (5, 6, ["0.2", "0.2.0"])]
    # A name around a word of something else is no valid part of what is above it; nothing aligned gives an empty span.
    words = [["A"], ["bbbb"], ["C"]]
    odd = penman.read('(x / thing :a (n / name :op1 "A" :op2 "C") :b (b / bbbb))')
    assert wordalign.align_spans(3, odd, wordalign.align_words(words, odd)) == [(0, 3, ["0", "0.0", "0.0.0", "0.0.1", "0.1"])]
    odd = penman.read('(r / rr :b (b / bbbb) :a (x / thing :n (n / name :op1 "A" :op2 "C")))')
    assert wordalign.align_spans(3, odd, wordalign.align_words(words, odd)) == [(1, 2, ["0.0"]), (3, 0, ["0.1"])]
    assert wordalign.align_spans(2, penman.read("(t / thing)"), {}) == [(2, 0, ["0"])]
    assert wordalign.align_words([], graph) == {} and wordalign.bare("run-01") == "run" and wordalign.bare('"X-1"') == "X" and wordalign.bare("20.5") == "20.5"


def test_report_of_overlap(spark):
    pairs = [
        (1, "(w / want-01 :ARG0 (b / boy) :ARG1 (g / go-01 :ARG0 b))", '(w / want-01 :ARG0 (b / girl) :ARG1 (g / go-01 :ARG1 (c / city :name "x")))'),
        (2, "(a / b)", "(a / b)"), (3, "(a / b :x (c / d))", "(q / r)"), (4, "(a", "(b / c)"), (5, None, "(b / c)"),
    ]
    got = {r["pair_id"]: r for r in evaluation.overlap_report(spark.createDataFrame(pairs, "pair_id long, a string, b string")).collect()}
    one = got[1]
    assert (one["match"], one["test"], one["gold"]) == (5, 7, 9) and {tuple(m) for m in one["mapping"]} == {("0", "0"), ("1", "1"), ("2", "2")}
    assert [tuple(r) for r in one["report"]] == [("aligned", "concept", "boy -> girl"), ("incorrect", "concept", "boy"), ("incorrect", "relation", "go-01 :ARG0 boy"), ("missing", "concept", "girl"), ("missing", "concept", "city"), ("missing", "attribute", "name _x_"), ("missing", "relation", "go-01 :ARG1 city")]
    assert got[2]["report"] == [] and got[4]["error"] and got[5]["error"]
    # Nodes that match nothing are mapped to nothing.
    assert {tuple(m) for m in got[3]["mapping"]} == {("0", None), ("1", None)} and got[3]["match"] == 0
    counts = spark.createDataFrame([(1, 5, 7, 9), (2, 2, 2, 2)], "pair_id long, match long, test long, gold long")
    assert [r["line"] for r in evaluation.score_lines(counts).orderBy("pair_id").collect()] == ["Sentence 1\nSmatch score: 0.625", "Sentence 2\nSmatch score: 1.000"]
    assert evaluation.score_lines(counts, True, True).first()["line"] == "Precision: 0.778\nRecall: 0.636\nDocument F-score: 0.700"


def test_mappings_reach_the_score():
    """The best mapping's matched triples, counted one by one, are the score that was climbed to."""
    import random

    rnd = random.Random(3)
    for _ in range(40):
        def graph():
            n = rnd.randint(1, 6)
            names = {str(i): rnd.choice("abc") for i in range(n)}
            return names, [(rnd.choice("xy"), rnd.choice(list(names)), rnd.choice("12")) for _ in range(rnd.randint(0, 3))], list({(rnd.choice("rs"), rnd.choice(list(names)), rnd.choice(list(names))) for _ in range(n)})
        a, b = graph(), graph()
        a, b = (a[0], list(set(a[1])), a[2]), (b[0], list(set(b[1])), b[2])
        match, _, _, m = edgedecode.best_mapping(a, b)
        count = sum(m[i] is not None and a[0][i] == b[0][m[i]] for i in a[0]) + sum((n, m[x], v) in b[1] for n, x, v in a[1]) + sum((n, m[x], m[y]) in b[2] for n, x, y in a[2])
        assert count == match


def test_differences_of_spans(spark):
    found = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "a"), (1, 1, 2, "b"), (1, 2, 3, "c")], "sent_id long, start int, stop int, frag string")
    gold = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 2, "x"), (2, 0, 1, "y")], "sent_id long, start int, stop int, frag string")
    assert sorted(map(tuple, evaluation.span_differences(found, gold).collect())) == [(1, "extra", 2, 3, "c"), (1, "incorrect", 1, 2, "b"), (1, "missing", 1, 2, "x"), (2, "missing", 0, 1, "y")]
