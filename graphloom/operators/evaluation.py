"""Span, alignment and graph-overlap scores."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import edgedecode, penman


def prf(match: Column, test: Column, gold: Column) -> list[Column]:
    """Precision, recall and F1; zero where nothing can be divided."""
    p = F.when(test > 0, match / test).otherwise(0.0)
    r = F.when(gold > 0, match / gold).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def span_f1(predicted: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """One row: matched, predicted, gold, precision, recall, f1 over all sentences; rows are compared as sets."""
    p, g = predicted.select(*on).distinct().withColumn("p", F.lit(1)), gold.select(*on).distinct().withColumn("g", F.lit(1))
    both = p.join(g, on, "full").agg(F.sum(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("matched"), F.count("p").alias("predicted"), F.count("g").alias("gold"))
    return both.select("matched", "predicted", "gold", *prf(F.col("matched"), F.col("predicted"), F.col("gold")))


def missing(predicted: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    return gold.select(*on).distinct().join(predicted.select(*on), on, "left_anti")


def alignment_counts(test: Column, gold: Column) -> Column:
    """(matched, test, gold) of two arrays of distinct alignments."""
    return F.struct(F.size(F.array_intersect(test, gold)).alias("matched"), F.size(test).alias("test"), F.size(gold).alias("gold"))


def overlap_pool(a: DataFrame, b: DataFrame) -> DataFrame:
    """Node pairs of two graphs that could match, with weights: equal lower-cased names (and values).

    ``a`` and ``b`` have pair_id, kind (instance, attribute), node, name, value. The join is on names and values, so
    only pairs that match something appear.
    """
    x = a.where("kind <> 'relation'").select("pair_id", "kind", F.lower("name").alias("name"), F.lower("value").alias("value"), F.col("node").alias("a"))
    y = b.where("kind <> 'relation'").select("pair_id", "kind", F.lower("name").alias("name"), F.lower("value").alias("value"), F.col("node").alias("b"))
    return x.join(y, ["pair_id", "kind", "name", "value"]).groupBy("pair_id", "a", "b").agg(F.count("*").alias("weight"))


def overlap_totals(counts: DataFrame) -> DataFrame:
    """Document precision, recall and F from per-pair match, test and gold counts."""
    t = counts.agg(F.sum("match").alias("match"), F.sum("test").alias("test"), F.sum("gold").alias("gold"))
    return t.select("match", "test", "gold", *prf(F.col("match"), F.col("test"), F.col("gold")))


def agreement_table(scores: DataFrame, users: list[str]) -> DataFrame:
    """Mean scores of each pair of annotators as a square table."""
    return scores.groupBy("user_a").pivot("user_b", users).agg(F.round(F.avg("f"), 2))


def relation_pool(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, a1, b1, a2, b2, weight): pairs of node pairs that would match relations of the same lower-cased name.

    ``a`` and ``b`` have pair_id, name, node (the source) and to.
    """
    x = a.select("pair_id", F.lower("name").alias("name"), F.col("node").alias("a1"), F.col("to").alias("a2"))
    y = b.select("pair_id", F.lower("name").alias("name"), F.col("node").alias("b1"), F.col("to").alias("b2"))
    return x.join(y, ["pair_id", "name"]).groupBy("pair_id", "a1", "b1", "a2", "b2").agg(F.count("*").alias("weight"))


def alignment_scores(df: DataFrame, test: Column, gold: Column) -> DataFrame:
    """One row: matched, test, gold, precision, recall, f1 over all sentences' alignments."""
    c = df.select(alignment_counts(test, gold).alias("c")).agg(*(F.coalesce(F.sum(f"c.{x}"), F.lit(0)).alias(x) for x in ("matched", "test", "gold")))
    return c.select("matched", "test", "gold", *prf(F.col("matched"), F.col("test"), F.col("gold")))


def span_differences(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(sent_id, kind, start, stop, frag): found spans that are ``incorrect`` (the gold has another fragment there) or
    ``extra`` (it has none), and gold spans that are ``missing``. Rows of equal spans count once."""
    keys = ["sent_id", "start", "stop"]
    f, g = found.select(*keys, "frag").distinct(), gold.select(*keys, "frag").distinct()
    wrong = f.join(g, [*keys, "frag"], "left_anti").join(g.select(*keys).distinct().withColumn("there", F.lit(True)), keys, "left")
    wrong = wrong.select("sent_id", F.when(F.col("there"), "incorrect").otherwise("extra").alias("kind"), "start", "stop", "frag")
    return wrong.unionByName(g.join(f, [*keys, "frag"], "left_anti").select("sent_id", F.lit("missing").alias("kind"), "start", "stop", "frag"))


#: Pairs of texts that a task remembers: bounds memory, bears on time alone.
REMEMBERED = 4096
REPORT = "pair_id long, match long, test long, gold long, mapping array<struct<a:string,b:string>>, report array<struct<side:string,kind:string,text:string>>, error string"


def overlap_report(pairs: DataFrame, restarts: int = 4) -> DataFrame:
    """(pair_id, match, test, gold, mapping, report, error): the overlap of graphs ``a`` and ``b`` (PENMAN) and what does not match.

    ``mapping`` has each node of a and the node of b that it is mapped to, or null; pairs that match nothing are taken
    out. ``report`` lists mapped nodes of other concepts, what is only in a (incorrect) and what is only in b (missing).
    A task remembers what the last texts gave, and equal ones are not compared again.
    """

    def run(batches):
        @lru_cache(REMEMBERED)
        def told(a, b):
            try:
                x, y = (edgedecode.triples_of(penman.read(t or "", gorn=False)) for t in (a, b))
                match, test, gold, mapping = edgedecode.best_mapping(x, y, restarts)
                return match, test, gold, list(mapping.items()), edgedecode.differences(x, y, mapping), None
            except penman.PenmanError as e:
                return None, None, None, None, None, str(e)

        for pdf in batches:
            rows = [(pair, *told(a, b)) for pair, a, b in zip(pdf.pair_id, pdf.a, pdf.b)]
            yield pd.DataFrame(rows, columns=["pair_id", "match", "test", "gold", "mapping", "report", "error"]).astype({"match": "Int64", "test": "Int64", "gold": "Int64"})

    return pairs.select("pair_id", "a", "b").mapInPandas(run, REPORT)


def score_lines(counts: DataFrame, precision_recall: bool = False, single: bool = False) -> DataFrame:
    """(pair_id, line): scores as they are printed, one pair after another, or with ``single`` the document's in one row."""
    rows = overlap_totals(counts).withColumn("pair_id", F.lit(None).cast("long")) if single else counts.select("pair_id", "match", "test", "gold", *prf(F.col("match"), F.col("test"), F.col("gold")))
    number = lambda c: F.format_string("%.3f", F.col(c))
    parts = [] if single else [F.concat(F.lit("Sentence "), F.col("pair_id").cast("string"))]
    parts += [F.concat(F.lit("Precision: "), number("precision")), F.concat(F.lit("Recall: "), number("recall"))] if precision_recall else []
    parts.append(F.concat(F.lit("Document F-score: " if single else "Smatch score: "), number("f1")))
    return rows.select("pair_id", F.concat_ws("\n", *parts).alias("line"))
