"""Dictionaries from aligned graphs: fragments cut out by node ids, counted, and given their features."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import penman, wordalign
from graphloom.operators import dictionary, graphs

SPANS = "sent_id long, span_id int, start int, stop int, phrase string, frag string, coref boolean, node_ids array<string>, concepts array<string>, error string"
KINDS = {"span_id": pa.int32(), "start": pa.int32(), "stop": pa.int32(), "phrase": pa.string(), "frag": pa.string(), "coref": pa.bool_(), "node_ids": pa.list_(pa.string()), "concepts": pa.list_(pa.string()), "error": pa.string()}
#: Features of a dictionary entry by the name of the setting that asks for them.
FEATURES = {"corpusIndicator": "corpus", "corpusLength": "corpus_len", "count": "N", "logPrConcept": "logPrConcept", "conceptGivenPhrase": "c|p", "phraseGivenConcept": "p|c"}


#: Most nodes of a fragment whose text is remembered by its shape, which bounds memory alone.
REMEMBERED = 8


@lru_cache(1 << 16)
def shown(concepts: tuple, links: tuple) -> str | None:
    """The text of a fragment by its concepts and, for each but the first, the number of the node above and the label between; none if it falls apart."""
    way = [0]
    for k, (above, _) in enumerate(links, 1):
        while way and way[-1] != above:
            way.pop()
        if not way:
            return None
        way.append(k)
    return penman.show(("0", {str(k): (None, c) for k, c in enumerate(concepts)}, [(str(a), label, str(k), "tree") for k, (a, label) in enumerate(links, 1)]), 0)


def fragment_text(graph, ids: list[str], above) -> str:
    """The fragment that the ids cut out, in the form in which fragments are compared."""
    at = {x: k for k, x in enumerate(ids)}
    if 0 < len(ids) == len(at) <= REMEMBERED and all(x in graph[1] for x in ids):
        links = tuple((at.get(a), label) for a, label in (above.get(x, (None, None)) for x in ids[1:]))
        text = shown(tuple([graph[1][x][1] for x in ids]), links)
        if text is not None:
            return text
    return penman.show(penman.cut_out(graph, ids, above), 0)


def span_fragments(blocks: DataFrame) -> DataFrame:
    """(sent_id, span_id, start, stop, phrase, frag, coref, node_ids, concepts, error): a row for each alignment of ``blocks``.

    ``blocks`` has sent_id, words, penman and alignments. A fragment is written in the form in which fragments are
    compared. What is malformed, outside the sentence or does not hang together has no fragment and the reason in
    ``error``; a graph that cannot be read has one such row.
    """

    def run(batches):
        from graphloom.operators.training import SPAN

        # An alignment's text says the same in every sentence; a batch reads each once.
        parsed: dict[str, tuple | None] = {}

        def alignment(part: str):
            m = SPAN.match(part)
            return m and (int(m[2]), int(m[3]), bool(m[1]), sorted(m[4].split("+")))

        for batch in batches:
            of, rows = [], []
            parsed.clear()
            given = (batch.column(x).to_pylist() for x in ("words", "penman", "alignments"))
            for i, (words, text, alignments) in enumerate(zip(*given)):
                words = words or []
                try:
                    graph = penman.read(text or "")
                    above = penman.parents(graph)
                except penman.PenmanError as e:
                    of.append(i)
                    rows.append((None, None, None, None, None, None, None, None, str(e)))
                    continue
                for k, part in enumerate((alignments or "").split()):
                    row = [None] * 7
                    of.append(i)
                    try:
                        if part not in parsed:
                            parsed[part] = alignment(part)
                        if not parsed[part]:
                            raise penman.PenmanError(f"not an alignment: {part}")
                        start, stop, coref, ids = parsed[part]
                        row[:2], row[4:6] = (start, stop), (coref, ids)
                        if not start < stop <= len(words):
                            raise penman.PenmanError(f"no words {start}-{stop}")
                        row[3] = fragment_text(graph, ids, above)
                        row[2], row[6] = " ".join(words[start:stop]), [graph[1][at][1] for at in ids]
                        rows.append((k, *row, None))
                    except penman.PenmanError as e:
                        rows.append((k, *row, str(e)))
            columns = list(zip(*rows)) or [()] * len(KINDS)
            sent = batch.column("sent_id").cast(pa.int64()).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([sent, *(pa.array(c, kind) for c, kind in zip(columns, KINDS.values()))], names=["sent_id", *KINDS])

    return blocks.select("sent_id", "words", "penman", "alignments").mapInArrow(run, SPANS)


def concept_table(spans: DataFrame, sentences: DataFrame, names=("corpusIndicator", "corpusLength", "count", "conceptGivenPhrase", "phraseGivenConcept"), most: int = 10_000) -> DataFrame:
    """(words, frag, features, indices): the dictionary that aligned graphs teach, as ``Knowledge.dictionary`` takes it.

    ``spans`` is what ``span_fragments`` gives, ``sentences`` (sent_id, words) are scanned for the phrases: a phrase counts
    once for each entry that has it. ``indices`` are the sentences an entry was seen in, unless they are over ``most``.
    """
    unknown = sorted(set(names) - set(FEATURES))
    if unknown:
        raise ValueError(f"unknown features of a dictionary: {unknown}")
    pairs = spans.where("error is null").select("phrase", dictionary.strip_op_numbers(F.col("frag")).alias("frag"), F.col("sent_id").alias("sent"), "concepts")
    # Fragments are cut out once: for the entries with their sentences and the concepts in them; all else is known from
    # this small table.
    counts = graphs.cut(dictionary.phrase_concept_counts(pairs, most))
    entries = counts.select(F.split("phrase", " ").alias("words"), "frag")
    seen = dictionary.match_dictionary(sentences, entries).groupBy("phrase").agg(F.count("*").alias("n"))
    table = dictionary.derived_features(counts, dictionary.fragment_counts(counts, F.sum("n")), seen).join(counts.select("phrase", "frag", "indices"), ["phrase", "frag"])
    if "logPrConcept" in names:
        held = counts.select("frag", F.inline("held")).groupBy("frag", "concepts").agg(F.sum("n").alias("n"))
        singles = dictionary.concept_counts(held.select(F.explode("concepts").alias("concept"), "n"), F.sum("n"))
        inside = held.groupBy("frag").agg(F.min("concepts").alias("concepts"))
        table = table.join(dictionary.fragment_log_probability(inside, singles), "frag", "left")
    column = {"corpusIndicator": "corpus", "corpusLength": "corpus_len", "count": "count", "logPrConcept": "log_pr", "conceptGivenPhrase": "c_given_p", "phraseGivenConcept": "p_given_c"}
    features = F.create_map(*(x for n in names for x in (F.lit(FEATURES[n]), F.col(column[n]).cast("double"))))
    return table.select(F.split("phrase", " ").alias("words"), "frag", features.alias("features"), F.transform("indices", lambda i: i.cast("int")).alias("indices"))


def concept_line(words: Column, frag: Column, features: Column, indices: Column) -> Column:
    """An entry as a line of a dictionary's file: ``words ||| frag ||| k=v ... ||| idx ...``."""
    told = F.array_join(F.transform(F.array_sort(F.map_entries(features)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return F.concat_ws(" ||| ", F.array_join(words, " "), frag, told, F.array_join(F.transform(indices, lambda i: i.cast("string")), " "))


def older_alignments(df: DataFrame) -> DataFrame:
    """(sent_id, start, stop, node_ids): the spans of the older aligner; ``df`` has sent_id, stems (of each word) and penman.

    A graph that cannot be read has no spans.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for sent, stems, text in zip(pdf.sent_id, pdf.stems, pdf.penman):
                try:
                    graph = penman.read(text or "")
                except penman.PenmanError:
                    continue
                own = [list(s) for s in stems] if stems is not None else []
                rows += [(sent, *s) for s in wordalign.align_spans(len(own), graph, wordalign.align_words(own, graph))]
            yield pd.DataFrame(rows, columns=["sent_id", "start", "stop", "node_ids"])

    return df.select("sent_id", "stems", "penman").mapInPandas(run, "sent_id long, start int, stop int, node_ids array<string>")
