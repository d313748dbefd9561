"""Relational operators: golden examples and DuckDB twins on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import edgedecode, penman
from graphloom.operators import graphs
from graphloom.plans.queries import ORACLE, QUERIES
from graphloom.sources import text as reader

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_blocks(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n\na\nc\nb")], "id int, t string")
    assert [r["block"] for r in reader.blocks(df, "id", "t").collect()] == ["a\nb\nc", "a\nc\nb"]


def test_metadata(spark):
    m = spark.range(1).select(reader.metadata(F.lit("# ::date 12 15 2005 ::annotator Jeff ::preferred")).alias("m")).first()["m"]
    assert m == {"::date": "12 15 2005", "::annotator": "Jeff", "::preferred": ""}


def test_cycles(spark):
    def cyclic(edges):
        return graphs.has_cycle(spark.createDataFrame([(1, a, b) for a, b in edges], "sent_id int, src int, dst int")).first()["cyclic"]

    assert cyclic([(1, 2), (2, 3), (3, 1)])
    assert not cyclic([(1, 2), (1, 3), (2, 3)])
    assert not cyclic([(1, 2), (2, 3), (2, 4), (4, 5), (4, 6), (5, 6), (6, 3)])
    assert cyclic([(1, 2), (2, 3), (2, 4), (4, 5), (5, 6), (6, 3), (6, 4)])


def test_penman_round_trip():
    text = '(d / deny-01 :ARG0 (c / country :name (n / name :op1 "Iran")) :ARG1 (r / run-01 :ARG0 c))'
    g = penman.read(text)
    assert penman.show(g) == text.replace(":ARG1 (r / run-01 :ARG0 c)", ":ARG1 (r / run-01 :ARG0 c)")
    assert [e for e in g[2] if e[3] == "reentrant"] == [("0.1", ":ARG0", "0.0", "reentrant")]
    assert penman.show(penman.read("(d / date-entity :year 2002 :month 1 :day 5)"), 0) == "(date-entity :day 5 :month 1 :year 2002)"
    with pytest.raises(penman.PenmanError):
        penman.read("(a / b")


def test_decoders():
    scores = [(1, 2, ":r", 6.0), (2, 3, ":r", -6.0), (1, 3, ":r", 3.0)]
    scores += [(a, b, ":r", 0.0) for a in (1, 2, 3) for b in (1, 2, 3) if a != b and (a, b) not in {(1, 2), (2, 3), (1, 3)}]
    assert {e[:2] for e in edgedecode.connected_subgraph([1, 2, 3], [], scores)} == {(1, 2), (1, 3)}
    limited = edgedecode.greedy([1, 2, 3], [], scores, {":r": 1})
    assert len(limited) == 2 and all(sum(e[0] == n for e in limited) <= 1 for n in (1, 2, 3))
    out, good = edgedecode.relaxed([1, 2, 3], [], scores, {":r": 1})
    assert not good or all(sum(e[0] == n for e in out) <= 1 for n in (1, 2, 3))


def test_overlap_with_itself():
    g = edgedecode.triples_of(penman.read("(w / want-01 :ARG0 (b / boy) :ARG1 (g / go-01 :ARG0 b))"))
    matched, test, gold = edgedecode.overlap(g, g)
    assert matched == test == gold == 7
