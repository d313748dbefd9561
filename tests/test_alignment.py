"""The aligner on the documented examples (fixed values: sentences, graphs and their spans)."""

import pytest

from graphloom.functions import align, penman

NORTH = """(d / deny-01 :ARG0 (c / country :name (n / name :op1 "North" :op2 "Korea")) :ARG1 (a / access-01 :ARG0 o :ARG1 (f / facility :poss c) :mod (f2 / full))
  :ARG2 (o / organization :name (n2 / name :op1 "IAEA")))"""
GOLDEN = [
    ("2002-01-05", "(d / date-entity :year 2002 :month 1 :day 5)", "0-1|0+0.0+0.1+0.2"),
    ("International ; military ; terrorism", "(a / and :op1 (i / international) :op2 (m / military) :op3 (t / terrorism))", "1-2|0 0-1|0.0 2-3|0.1 4-5|0.2"),
    ("Saudi Arabia ( SA )", '(c / country :name (n / name :op1 "Saudi" :op2 "Arabia"))', "0-2|0+0.0+0.0.0+0.0.1"),
    ("North Korea has denied the IAEA full access to its facilities .", NORTH, "0-2|0.0+0.0.0+0.0.0.0+0.0.0.1 5-6|0.2+0.2.0+0.2.0.0 3-4|0 7-8|0.1 6-7|0.1.1 10-11|0.1.0"),
]
#: Rule by rule: what each aligns, with the node ids.
RULES = [
    ("17 July 2003", "(d / date-entity :day 17 :month 7 :year 2003)", "0-3|0+0.0+0.1+0.2"),
    ("021114", "(d / date-entity :year 2002 :month 11 :day 14)", "0-1|0+0.0+0.1+0.2"),
    ("U.S. troops", '(t / troop :poss (c / country :name (n / name :op1 "United" :op2 "States")))', "0-1|0.0+0.0.0+0.0.0.0+0.0.0.1 1-2|0"),
    ("the UN", '(o / organization :name (n / name :op1 "United" :op2 "Nations"))', "1-2|0+0.0+0.0.0+0.0.1"),
    ("a U N vote", '(v / vote-01 :ARG0 (o / organization :name (n / name :op1 "United" :op2 "Nations")))', "1-3|0.0+0.0.0+0.0.0.0+0.0.0.1 3-4|0"),
    ("he did not win", "(w / win-01 :polarity - :ARG0 (h / he))", "0-1|0.1 2-3|0.0 3-4|0"),
    ("unhappy", "(h / happy :polarity -)", "0-1|0+0.0"),
    ("the tallest tree", "(t / tree :mod (a / tall :degree (m / most)))", "1-2|0.0+0.0.0 2-3|0"),
    ("five miles", "(d / distance-quantity :quant 5 :unit (m / mile))", "0-1|0.0 1-2|0+0.1"),
    ("teachers", "(p / person :ARG0-of (t / teach-01))", "0-1|0+0.0"),
    ("president", "(p / person :ARG0-of (h / have-org-role-91 :ARG2 (q / president)))", "0-1|0+0.0+0.0.0"),
    ("governments", "(g / government-organization :ARG0-of (x / govern-01))", "0-1|0+0.0"),
    ("three dogs", "(d / dog :quant 3)", "0-1|0.0 1-2|0"),
]


def spans(text):
    return set(text.split())


@pytest.mark.parametrize("words, graph, expected", GOLDEN + RULES)
def test_spans(words, graph, expected):
    found = align.show(align.align(words.split(), penman.read(graph), {"denied": ["deny"], "miles": ["mile"], "dogs": ["dog"], "troops": ["troop"]}))
    assert spans(found) == spans(expected)


def test_words_and_nodes_are_used_once():
    for words, graph, _ in GOLDEN + RULES:
        found = align.align(words.split(), penman.read(graph))
        used = [w for s in found for w in range(s.start, s.stop)]
        nodes = [n for s in found for n in s.nodes]
        assert len(used) == len(set(used)) and len(nodes) == len(set(nodes))


def test_rules_are_data():
    assert [r.name for r in align.RULES] == [
        "namedEntity", "fuzzyNamedEntity", "dateEntity", "singleConcept", "fuzzyConcept", "US", "namedEntityAcronym", "namedEntityCollect",
        "namedEntityCollectSingle", "unalignedEntity", "haveRoleArg2", "haveOrgRoleArg1", "quantity", "argOf", "personOf", "governmentOrg",
        "minusPolarity", "polarityChild", "est", "haveRoleArg2", "haveOrgRoleArg1", "wiki",
    ]
    assert align.align([], penman.read("(a / b)")) == []
