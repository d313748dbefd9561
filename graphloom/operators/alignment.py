"""Alignment of graphs to their sentences as a DataFrame operator, and what is known of its parts in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import align, penman

SPANS = "sent_id long, span_id int, start int, stop int, node_ids array<string>, error string"


def align_sentences(df: DataFrame, lexicon: DataFrame | dict[str, list[str]] | None = None) -> DataFrame:
    """(sent_id, span_id, start, stop, node_ids, error): the spans that the rules find for each sentence.

    ``df`` has sent_id, words and penman. ``lexicon`` has the stems of words: a table (surface, stem), of any size, or a
    small dictionary; a sentence is joined with its own words' stems only. A graph that cannot be read gives one row
    with ``error``; a sentence without any span gives none.
    """
    run = aligner(lexicon, lambda sent, found: [(sent, k, s.start, s.stop, sorted(s.nodes), None) for k, s in enumerate(found)], lambda sent, e: [(sent, None, None, None, None, str(e))])

    def typed(batches):
        for out in run(batches):
            yield pd.DataFrame(out, columns=["sent_id", "span_id", "start", "stop", "node_ids", "error"]).astype({"span_id": "Int32", "start": "Int32", "stop": "Int32"})

    return with_stems(df, lexicon).mapInPandas(typed, SPANS)


def aligned_lines(df: DataFrame, lexicon: DataFrame | dict[str, list[str]] | None = None) -> DataFrame:
    """``alignment_lines`` of what ``align_sentences`` finds, for sentences that are told apart by their ids: a line is written
    where its sentence is aligned, and no spans are dealt out."""
    run = aligner(lexicon, lambda sent, found: [(sent, align.show(found))] if found else [], lambda sent, e: [])
    return with_stems(df, lexicon).mapInPandas(lambda batches: (pd.DataFrame(out, columns=["sent_id", "alignments"]) for out in run(batches)), "sent_id long, alignments string")


def with_stems(df: DataFrame, lexicon) -> DataFrame:
    """The sentences, each with the stems of its own words if ``lexicon`` is a table; a small dictionary goes with the work."""
    df = df.select("sent_id", "words", "penman")
    if lexicon is None or isinstance(lexicon, dict):
        df = df.withColumn("stems", F.lit(None).cast("array<struct<surface:string,stems:array<string>>>"))
    else:
        table = lexicon.groupBy("surface").agg(F.array_sort(F.collect_set("stem")).alias("stems"))
        own = df.select("sent_id", F.explode(F.array_distinct("words")).alias("surface")).distinct().join(table, "surface")
        df = df.join(own.groupBy("sent_id").agg(F.collect_list(F.struct("surface", "stems")).alias("stems")), "sent_id", "left")
    return df


def aligner(lexicon, told, failed):
    """A function over batches of sentences that lists what ``told`` makes of a sentence's spans, or ``failed`` of an error."""
    small = lexicon if isinstance(lexicon, dict) else None

    def run(batches):
        for pdf in batches:
            rows = []
            for sent, words, text, stems in zip(pdf.sent_id, pdf.words, pdf.penman, pdf.stems):
                try:
                    known = small if small is not None else {s["surface"]: list(s["stems"]) for s in (stems if stems is not None else ())}
                    rows += told(sent, align.align(list(words) if words is not None else [], penman.read(text or ""), known))
                except penman.PenmanError as e:
                    rows += failed(sent, e)
            yield rows

    return run


def alignment_lines(spans: DataFrame) -> DataFrame:
    """(sent_id, alignments): ``start-stop|id+id`` of a sentence's spans in the order they were found."""
    line = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit("|"), F.array_join("node_ids", "+"))
    return spans.where("error is null").groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_id", line.alias("x")))), lambda s: s["x"]), " ").alias("alignments"))


def bare_concept(concept: Column) -> Column:
    """A concept without quotes and sense number; numbers stay."""
    return F.when(concept.rlike("^[0-9.]*$"), concept).otherwise(F.regexp_extract(concept, '^"?(.+?)-?[0-9]*"?$', 1))


def exact_matches(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """(sent_id, node_id, idx): the first word of a sentence that equals each node's bare concept; no word is kept free for others.

    ``nodes`` has sent_id, node_id and concept; ``words`` sent_id, idx and word. This is the part of the rule for single
    concepts that does not depend on what earlier nodes took.
    """
    n = nodes.select("sent_id", "node_id", bare_concept(F.col("concept")).alias("word")).where("word <> '' and word not like '-%'")
    return n.join(words, ["sent_id", "word"]).groupBy("sent_id", "node_id").agg(F.min("idx").alias("idx"))


def isolated(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with ``aligned``: whether a span that is no coreference holds them."""
    held = spans.where("not coref").select("sent_id", F.explode("node_ids").alias("node_id")).distinct().withColumn("aligned", F.lit(True))
    return nodes.join(held, ["sent_id", "node_id"], "left").withColumn("aligned", F.coalesce("aligned", F.lit(False)))
