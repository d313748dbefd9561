"""The whole parse of two sentences (fixed values: sentence F7 of the fixtures), its sources, and what fails."""

import pytest

from graphloom.operators import parsing
from graphloom.options import Settings, Stage1, Stage2

SENTENCE = "sent_id long, words array<string>, snt array<string>, pos array<string>, heads array<int>, rels array<string>, entities array<struct<start:int,stop:int,label:string>>, srl array<struct<pred:string,p_start:int,p_stop:int,arg:string,a_start:int,a_stop:int>>"
FORMS = ("nodes", "root", "edges", "AMR", "triples", "disconnectedAMR")


@pytest.fixture(scope="module")
def sentences(spark):
    spoke = ("The president spoke in November .".split(), "The president spoke in November.".split(), ["DT", "NN", "VBD", "IN", "NNP", "."], [1, 2, -1, 2, 3, 2], ["det", "nsubj", "root", "prep", "pobj", "punct"], [], [])
    smith = ("Mr. O'Neil \"Smith\" left".split(), "Mr. O'Neil \"Smith\" left".split(), ["NNP", "NNP", "NNP", "VBD"], [1, 2, 3, -1], ["nn", "nn", "nsubj", "root"], [(1, 3, "PER"), (0, 1, "GPE")], [])
    return spark.createDataFrame([(1, *spoke), (2, *smith), (3, ["?"], ["?"], ["."], [-1], ["root"], [], [])], SENTENCE)


@pytest.fixture(scope="module")
def knowledge(spark):
    entries = spark.createDataFrame([(["spoke"], "speak-01", {"N": 3.0}, [1, 50]), (["president"], "(person :ARG0-of (have-org-role-91 :ARG2 president))", {"N": 1.0}, [30])], "words array<string>, frag string, features map<string,double>, indices array<int>")
    first = spark.createDataFrame([("N", 1.0), ("ner", 2.0), ("datex3", 2.0), ("PassThrough", -1.0)], "feature string, value double")
    second = spark.createDataFrame([("C1=speak-01+C2=person", ":ARG0", 5.0), ("C1=speak-01+C2=date-entity", ":time", 3.0), ("Bias", ":ARG0", -1.0), ("Bias", ":time", -1.0), ("Edge", None, -0.5), ("C=speak-01+L=<ROOT>", None, 1.0)], "feature string, label string, value double")
    labels = spark.createDataFrame([(":ARG0", 1), (":time", 1), (":mod", 1000)], "label string, max_card int")
    stems = spark.createDataFrame([("spoke", "speak"), ("left", "leave"), ("left", "leav")], "surface string, stem string")
    predicates = spark.createDataFrame([("speak-02",), ("leave-11",)], "predicate string")
    return parsing.Knowledge(entries, stems, predicates, None, first, second, labels)


def settings(decoder="LR", **more):
    return Settings(stage1=Stage1(features=("length", "bias")), stage2=Stage2(decoder=decoder, features=("conceptBigram", "bias", "edgeCount", "rootConcept")), output=FORMS, **more)


@pytest.mark.parametrize("decoder", ["LR", "Greedy", "Alg2", "Alg1a"])
def test_from_text_to_graph(spark, sentences, knowledge, decoder):
    got = {r["sent_id"]: r for r in parsing.parse(sentences, knowledge, settings(decoder)).collect()}
    # The person is :ARG0 of the role frame, so the frame stands below it as :ARG0-of.
    assert got[1]["graph"] == "(s / speak-01 :ARG0 (p / person :ARG0-of (h / have-org-role-91 :ARG2 (p2 / president))) :time (d / date-entity :month 11))"
    assert set(got[1]["alignments"].split()) == {"2-3|0", "1-2|0.0+0.0.0+0.0.0.0", "4-5|0.1+0.1.0"}
    block = got[1]["block"].split("\n")
    assert block[:2] == ["# ::snt The president spoke in November.", "# ::tok The president spoke in November ."]
    assert "# ::root\t0\tspeak-01" in block and "# ::node\t0.1.0\t11\t4-5" in block
    assert "# ::edge\tspeak-01\ttime\tdate-entity\t0\t0.1\t" in block and "(s / speak-01, ARG0, p / person)" in block and "(d / date-entity\n  :month m" not in got[1]["block"]
    assert '"O\'Neil"' in got[2]["graph"] and '"Smith"' in got[2]["graph"]
    assert (got[3]["graph"], got[3]["alignments"], got[3]["error"]) == (parsing.EMPTY, parsing.EMPTY_SPAN, None)


def test_sources(spark, sentences, knowledge):
    every = ("NER", "DateExpr", "OntoNotes", "NEPassThrough", "PassThrough", "WordNetPassThrough", "verbs", "nominalizations")
    rows = parsing.invoke(sentences, knowledge, every, wiki=True).collect()
    got = {(r["sent_id"], r["start"], tuple(r["words"]), r["frag"]): r["features"] for r in rows}
    assert got[1, 2, ("spoke",), "speak-01"] == {"N": 3.0, "OntoNotes": 1.0}
    assert got[1, 2, ("spoke",), "speak-00"] == {"AddedVerb": 1.0, "AddedVerbOnly": 0.0}
    assert got[2, 3, ("left",), "leav-00"] == {"AddedVerb": 1.0, "AddedVerbOnly": 1.0}
    assert got[2, 3, ("left",), "leave-01"] == {"OntoNotes": 1.0, "OntoNotesOnly": 1.0}
    assert got[2, 3, ("left",), "leav"] == {"WordnetPassThrough": 1.0, "WordnetPassThroughOnly": 1.0}
    assert got[2, 1, ("O'Neil", '"Smith"'), '(person :wiki - :name (name :op "O\'Neil" :op "Smith"))'] == {"ner": 1.0, "ner_len": 2.0}
    assert got[1, 4, ("November",), "(date-entity :month 11)"] == {"datex3": 1.0, "datex_len": 1.0}
    assert got[1, 0, ("The",), "The"] == {"PassThrough": 1.0, "PassThroughOnly": 1.0}
    runs = {len(k[2]) for k in got if k[0] == 1 and k[1] == 0 and k[3].startswith("(thing")}
    assert runs == {1, 2, 3, 4, 5} and not any(k[2][-1:] == (".",) for k in got)
    assert not any(k[0] == 2 and k[1] == 0 and "name (name :op \"Mr" in k[3] for k in got)
    seen = {r["frag"] for r in parsing.invoke(sentences, knowledge, (), training=parsing.F.lit(30)).collect()}
    assert seen == {"speak-01"}
    with pytest.raises(ValueError, match="unknown concept sources"):
        parsing.invoke(sentences, knowledge, ("Guess",))


def test_errors(spark, sentences, knowledge):
    broken = spark.createDataFrame([(["spoke"], "(speak-01", {"N": 3.0}, [1])], "words array<string>, frag string, features map<string,double>, indices array<int>")
    bad = parsing.Knowledge(broken, weights1=knowledge.weights1, weights2=knowledge.weights2, labels=knowledge.labels)
    row = {r["sent_id"]: r for r in parsing.parse(sentences, bad, settings(ignore_errors=True)).collect()}[1]
    assert row["graph"] == parsing.EMPTY and row["error"].startswith("PenmanError") and "# ::alignments 0-1|0 " in row["block"]
    with pytest.raises(Exception, match="PenmanError"):
        parsing.parse(sentences, bad, settings()).collect()


def test_gold_spans(spark, sentences, knowledge):
    gold = spark.createDataFrame([(1, 0, 2, "president"), (1, 2, 3, "speak-01")], "sent_id long, start int, stop int, frag string")
    row = {r["sent_id"]: r for r in parsing.parse(sentences, knowledge, Settings(stage1=Stage1(oracle=True), stage2=Stage2(decoder="Alg2", features=("edgeCount", "rootConcept"))), gold=gold).collect()}[1]
    assert row["graph"].startswith("(s / speak-01 :") and set(row["alignments"].split()) == {"2-3|0", "0-2|0.0"}


@pytest.mark.parametrize("to, tokens, expected", [
    (["Riyadh-based", "group"], ["Riyadh", "-", "based", "group"], [(0, 1), (0, 1), (0, 1), (1, 2)]),
    (["Riyadh", "-", "based", "group"], ["Riyadh-based", "group"], [(0, 3), (3, 4)]),
    (["(", "a", ")"], ["-LRB-", "a-RRB-"], [(0, 1), (1, 3)]),
    (["ab", "c"], ["a", "bc"], [(0, 1), (0, 2)]),
    (["x"], ["y"], None),
])
def test_two_tokenizations(spark, to, tokens, expected):
    df = spark.createDataFrame([(to, tokens)], "a array<string>, b array<string>")
    got = df.select(parsing.token_spans(parsing.F.col("a"), parsing.F.col("b")).alias("r")).first()["r"]
    assert (None if got is None else [tuple(x) for x in got]) == expected
