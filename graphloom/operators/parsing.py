"""The whole parse: sentences to candidates, a cover of fragments, scored edges, a graph, and its text.

A sentence row has sent_id, words (tokens), snt (words of the untokenised text), pos, heads, rels, entities (array of
start, stop, label over ``words``) and srl. Candidates, features and scores are DataFrame plans; a sentence's fragments and its
graph are put together in an Arrow function, one call for many sentences.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import edgedecode, pairscores, penman, spans
from graphloom.operators import candidates, decoding, dictionary, edgefeatures
from graphloom.operators.graphs import cut
from graphloom.options import Settings
from graphloom.sources import text as reader

#: The graph that stands for nothing, and its alignment.
EMPTY, EMPTY_SPAN = "(a / amr-empty)", "0-1|0"


@dataclass(frozen=True)
class Knowledge:
    """Tables that a parse looks things up in; any may be left out.

    dictionary(words, frag, features, indices), stems(surface, stem), predicates(predicate, such as run-01),
    phrase_counts(words, n), weights1(feature, value), weights2(feature, label, value), labels(label, max_card).
    """

    dictionary: DataFrame | None = None
    stems: DataFrame | None = None
    predicates: DataFrame | None = None
    phrase_counts: DataFrame | None = None
    weights1: DataFrame | None = None
    weights2: DataFrame | None = None
    labels: DataFrame | None = None

    @staticmethod
    def load(spark: SparkSession, settings: Settings, stems: DataFrame | None = None) -> Knowledge:
        """The tables in the files that ``settings`` names; those it does not name are left out."""
        lines = lambda path: spark.read.text(path).where("value <> ''")
        s1, s2 = settings.stage1, settings.stage2
        labels = lines(s2.labelset).select(reader.label_limit(F.col("value")).alias("r")).select("r.*") if s2.labelset else None
        # A label set is short.
        known = [r["label"] for r in labels.select("label").collect()] if labels is not None else None
        weights = lambda path: lines(path).select(reader.weight(F.col("value"), known).alias("r")).select("r.*")
        return Knowledge(
            dictionary=lines(s1.concept_table).select(reader.concept_row(F.col("value")).alias("r")).select("r.words", "r.frag", "r.features", F.col("r.training_indices").alias("indices")) if s1.concept_table else None,
            stems=stems,
            predicates=lines(s1.predicates).select(F.trim("value").alias("predicate")) if s1.predicates else None,
            phrase_counts=lines(s1.phrase_counts).select(reader.phrase_count(F.col("value")).alias("r")).select("r.*") if s1.phrase_counts else None,
            weights1=weights(s1.weights).select("feature", "value") if s1.weights else None,
            weights2=weights(s2.weights) if s2.weights else None,
            labels=labels,
        )


# Candidates --------------------------------------------------------------------------------------

#: Concept sources beside the dictionary, NER and dates: a function of place rows (sent_id, start, word, tag, only, stems, and
#: n and ahead, the sentence's length and the words from the place on), the knowledge, and whether names have wiki links.
SOURCES: dict[str, Callable] = {}
#: Sources whose candidates come first: a place at which none of theirs starts is ``only`` for the others.
FIRST = ("NER", "DateExpr")


def source(name: str):
    return lambda f: SOURCES.setdefault(name, f)


def features_of(**named) -> Column:
    return F.create_map(*[x for k, v in named.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("double"))])


def rows(df: DataFrame, words: Column, frag: Column, features: Column, indices: Column | None = None) -> DataFrame:
    indices = F.array().cast("array<int>") if indices is None else indices
    return df.select("sent_id", F.col("start").cast("int").alias("start"), words.alias("words"), frag.alias("frag"), features.alias("features"), indices.alias("indices"))


@source("OntoNotes")
def listed_predicates(places, knowledge, wiki):
    """``stem-01`` of each stem that the predicate list has."""
    if knowledge.predicates is None:
        return None
    verbs = knowledge.predicates.select(F.regexp_extract("predicate", "^(.+)-([0-9]+)$", 1).alias("stem")).distinct()
    found = places.select("sent_id", "start", "word", "only", F.explode("stems").alias("stem")).join(verbs, "stem", "left_semi")
    with_only = F.when(F.col("only"), features_of(OntoNotes=1, OntoNotesOnly=1)).otherwise(features_of(OntoNotes=1))
    return rows(found, F.array("word"), F.concat("stem", F.lit("-01")), with_only)


@source("NEPassThrough")
def name_runs(places, knowledge, wiki):
    """One to six name-like words as an unknown thing's name; a run never reaches the last word."""
    runs = places.select("sent_id", "start", "only", "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: F.struct(j.alias("j"), F.slice("ahead", 1, j).alias("ws")))).alias("r"))
    runs = runs.where((F.col("start") + F.col("r.j") < F.col("n")) & F.forall("r.ws", lambda w: w.rlike("^[A-Za-z0-9.-]*$"))).select("sent_id", "start", "only", "r.ws")
    ops = F.array_join(F.transform("ws", lambda w: F.concat(F.lit(":op "), w)), " ")
    frag = F.concat(F.lit("(thing :wiki - :name (name " if wiki else "(thing :name (name "), ops, F.lit("))"))
    plain = dict(NEPassThrough=1, NEPassThrough_len=F.size("ws"))
    return rows(runs, F.col("ws"), frag, F.when(F.col("only"), features_of(**plain, NEPassThroughOnly=1)).otherwise(features_of(**plain)))


def flag(only: str = "only") -> Column:
    return F.when(F.col(only), 1).otherwise(0)


@source("PassThrough")
def word_itself(places, knowledge, wiki):
    """Words of letters and digits stand for themselves."""
    return rows(places.where(F.col("word").rlike("^[A-Za-z0-9]*$")), F.array("word"), F.col("word"), features_of(PassThrough=1, PassThroughOnly=flag()))


def shortest(stems: str = "stems") -> Column:
    return F.array_min(F.transform(stems, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]


@source("WordNetPassThrough")
def shortest_stem(places, knowledge, wiki):
    return rows(places.where(F.size("stems") > 0), F.array("word"), shortest(), features_of(WordnetPassThrough=1, WordnetPassThroughOnly=flag()))


@source("verbs")
def added_verbs(places, knowledge, wiki):
    """``stem-00`` of the shortest stem, or of the word, for words tagged as verbs."""
    return rows(places.where(F.col("tag").startswith("V")), F.array("word"), F.concat(F.coalesce(shortest(), F.col("word")), F.lit("-00")), features_of(AddedVerb=1, AddedVerbOnly=flag()))


@source("nominalizations")
def nominalizations(places, knowledge, wiki):
    """Accepted as a source, never gives a candidate."""
    return None


def places_of(sentences: DataFrame) -> DataFrame:
    """(sent_id, start, n, ahead, word, tag): a row for each word with the seven after it."""
    spread = F.posexplode(F.transform("words", lambda w, i: F.slice("words", i + 1, 8))).alias("start", "ahead")
    return sentences.select("sent_id", "pos", F.size("words").alias("n"), spread).select("sent_id", "start", "n", "ahead", F.get("ahead", F.lit(0)).alias("word"), F.get("pos", F.col("start")).alias("tag"))


def with_stems(places: DataFrame, stems: DataFrame | None) -> DataFrame:
    """``places`` with the sorted stems of the word; where ``stems`` has a column ``pos``, those for the tag's part of speech."""
    none = F.array().cast("array<string>")
    if stems is None:
        return places.withColumn("stems", none)
    by = ["word"]
    if "pos" in stems.columns:
        places, by = places.withColumn("pos", part_of_speech(F.col("tag"))), ["word", "pos"]
    found = stems.withColumnRenamed("surface", "word").groupBy(*by).agg(F.array_sort(F.collect_set("stem")).alias("stems"))
    return places.join(found, by, "left").withColumn("stems", F.coalesce("stems", none)).drop("pos")


def part_of_speech(tag: Column) -> Column:
    """verb, noun, adj or adv by the first letters of a tag; other tags have none (null)."""
    return F.when(tag.startswith("V"), "verb").when(tag.startswith("N"), "noun").when(tag.startswith("J"), "adj").when(tag.startswith("RB"), "adv")


def from_source(name: str, places: DataFrame, knowledge: Knowledge = Knowledge(), wiki: bool = False) -> DataFrame:
    """(sent_id, start, phrase, frag) of one source alone; every place is ``only``."""
    marked = with_stems(places.withColumn("only", F.lit(True)), knowledge.stems)
    found = SOURCES[name](marked, knowledge, wiki)
    found = rows(marked.where("false"), F.array("word"), F.col("word"), features_of(none=0)) if found is None else found
    return found.select("sent_id", "start", F.array_join("words", " ").alias("phrase"), "frag")


def from_dictionary(sentences: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose words stand in a sentence."""
    found = dictionary.match_dictionary(sentences, entries.select("words", F.col("words").alias("entry"), "frag", "features", "indices"))
    return rows(found, F.col("entry"), F.col("frag"), F.col("features"), F.col("indices"))


def from_entities(sentences: DataFrame, wiki: bool) -> DataFrame:
    """Named entities, spelt as in the untokenised text; labels without a concept give nothing."""
    spots = sentences.select("sent_id", "words", "snt", token_spans(F.col("snt"), F.col("words")).alias("at"), F.explode("entities").alias("e"))
    first, last = F.get("at", F.col("e.start")), F.get("at", F.col("e.stop") - 1)
    spelt = F.slice("snt", first["left"] + 1, last["right"] - first["left"])
    spots = spots.where(F.col("e.label").isin(*candidates.ENTITY_CONCEPTS)).select("sent_id", F.col("e.start").alias("start"), F.slice("words", F.col("e.start") + 1, F.col("e.stop") - F.col("e.start")).alias("ws"), F.col("e.label").alias("label"), spelt.alias("spelt"))
    frag = candidates.entity_fragment(F.col("label"), F.coalesce("spelt", "ws"), wiki)
    return rows(spots, F.col("ws"), frag, features_of(ner=1, ner_len=F.size("ws")))


def from_dates(places: DataFrame) -> DataFrame:
    tails = places.select(F.struct("sent_id", F.col("start")).alias("at"), "ahead").withColumn("tail", F.array_join("ahead", "\t"))
    found = candidates.date_candidates(tails.select(F.struct("at", "ahead").alias("of"), "tail"), "of", "tail")
    found = found.select("of.at.sent_id", "of.at.start", F.slice("of.ahead", 1, F.col("n_words")).alias("ws"), "frag", "feature", "n_words")
    return rows(found, F.col("ws"), F.col("frag"), F.map_from_arrays(F.array("feature", F.lit("datex_len")), F.array(F.lit(1.0), F.col("n_words").cast("double"))))


def invoke(sentences: DataFrame, knowledge: Knowledge, names=FIRST, wiki: bool = False, training: Column | None = None) -> DataFrame:
    """(sent_id, start, words, frag, features, indices): what may be invoked at each word, one row for each phrase and fragment.

    The dictionary, entities and dates come first; words at which none of them starts are ``only`` for the other
    sources, which say so in a feature. Features of equal candidates add up, their indices are put together.
    ``training`` is the sentence's own index: entries seen only within 20 sentences of it are left out.
    """
    unknown = sorted(set(names) - set(SOURCES) - set(FIRST))
    if unknown:
        raise ValueError(f"unknown concept sources: {unknown}")
    places = places_of(sentences)
    parts = []
    if knowledge.dictionary is not None:
        found = from_dictionary(sentences, knowledge.dictionary)
        parts.append(found if training is None else dictionary.leave_one_out(found, training))
    if "NER" in names:
        parts.append(from_entities(sentences, wiki))
    if "DateExpr" in names:
        parts.append(from_dates(places))
    def together(parts: list[DataFrame]) -> DataFrame:
        """One table; of a single part it is that part, which stays dealt out as it is."""
        first, *more = parts or [rows(places.where("false"), F.array("word"), F.col("word"), features_of(none=0))]
        for part in more:
            first = first.unionByName(part)
        return first

    # Several parts are dealt out by sentence alone, so that all that follows stays there.
    by_sentence = lambda df: df.repartition("sent_id") if len(parts) > 1 else df
    rest = [x for x in names if x in SOURCES]
    if rest:
        taken = by_sentence(together(parts).select("sent_id", "start")).distinct().withColumn("taken", F.lit(True))
        marked = places.join(taken, ["sent_id", "start"], "left").withColumn("only", F.col("taken").isNull())
        marked = with_stems(marked, knowledge.stems)
        parts += [more for name in rest if (more := SOURCES[name](marked, knowledge, wiki)) is not None]
    base = by_sentence(together(parts))
    return dictionary.merge_candidates(base, ["sent_id", "start", "words", "frag"])


def token_spans(to: Column, tokens: Column) -> Column:
    """For each of ``tokens`` the range (left, right) of words in ``to``, another cutting of the same characters.

    Brackets count as they are written in treebanks. If the two do not spell the same text there is no range (null).
    """
    plain = lambda ws: F.transform(ws, lambda w: F.replace(F.replace(F.replace(w, F.lit(" ")), F.lit("("), F.lit("-LRB-")), F.lit(")"), F.lit("-RRB-")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))
    on = lambda z, w: F.struct((z["n"] + F.length(w)).alias("n"), F.array_append(z["ends"], z["n"] + F.length(w)).alias("ends"))
    ends = lambda ws: F.aggregate(ws, start, on, lambda z: z["ends"])
    let = edgefeatures.let
    named = lambda **parts: F.named_struct(*(x for k, v in parts.items() for x in (F.lit(k), v)))
    before = lambda s, i: F.when(i > 0, F.get(s["ends"], i - 1)).otherwise(0)
    ranges = lambda s: F.transform(s["ends"], lambda e, i: named(left=F.size(F.filter(s["stops"], lambda x: x <= before(s, i))), right=F.size(F.filter(s["stops"], lambda x: x < e)) + 1))
    both = let(named(to=plain(to), words=plain(tokens)), lambda b: named(stops=ends(b["to"]), ends=ends(b["words"]), same=F.array_join(b["to"], "") == F.array_join(b["words"], "")))
    return let(both, lambda s: F.when(s["same"], ranges(s)))


# Stage 1 -----------------------------------------------------------------------------------------


def own_features() -> Column:
    """The features that a candidate brings along, as an array of (feature, value)."""
    return F.array_sort(F.transform(F.map_entries("features"), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("value"))))


def with_counts(found: DataFrame, knowledge: Knowledge) -> DataFrame:
    if knowledge.phrase_counts is None:
        return found.withColumn("phrase_n", F.lit(0))
    counts = knowledge.phrase_counts.groupBy("words").agg(F.max("n").alias("phrase_n"))
    return found.join(counts, "words", "left").withColumn("phrase_n", F.coalesce("phrase_n", F.lit(0)))


def candidate_rows(sentences: DataFrame, knowledge: Knowledge, s1, keep=(), every: bool = False) -> DataFrame:
    """(sent_id, columns to keep, candidates): a row for each sentence (or, without ``every``, only those with candidates), whose candidates (see ``invoke``) have
    k, start, stop, words, frag and their features, of both kinds.

    A sentence's candidates are numbered from 0 and stand in one row beside its words while features are made, so that no
    candidate carries its sentence. Those of a small dictionary alone are found in that row as well.
    """
    training = F.col("sent_id") if s1.leave_one_out else None
    s = sentences.select("sent_id", *keep, F.col("words").alias("sent_words"), "pos")
    alone = knowledge.dictionary is not None and not s1.sources and training is None
    sizes, held = dictionary.extent(knowledge.dictionary) if alone else ([], 0)
    if alone and held <= dictionary.HELD:
        s = in_rows(s, with_counts(dictionary.merge_candidates(knowledge.dictionary, ["words", "frag"]), knowledge), sizes, every)
    else:
        one = F.struct("start", "words", "frag", own_features().alias("own"), "indices", "phrase_n")
        found = with_counts(invoke(sentences, knowledge, s1.sources, s1.wiki, training), knowledge)
        s = s.join(found.groupBy("sent_id").agg(F.sort_array(F.collect_list(one)).alias("candidates")), "sent_id", "left" if every else "inner")
        s = s.withColumn("candidates", F.coalesce("candidates", F.array().cast(s.schema["candidates"].dataType))) if every else s

    def told(c: Column, k: Column) -> Column:
        return F.struct(k.cast("int").alias("k"), c["start"].alias("start"), (c["start"] + F.size(c["words"])).alias("stop"), c["words"].alias("words"), c["frag"].alias("frag"), F.concat(c["own"], candidates.feature_list(c, s1.features)).alias("features"))

    return s.select("sent_id", *keep, F.transform("candidates", told).alias("candidates"))


def in_rows(s: DataFrame, entries: DataFrame, sizes: list[int], every: bool = False) -> DataFrame:
    """``s`` with the dictionary's candidates for its words; ``entries`` are few (see ``dictionary.HELD``) and go with the work."""
    entries = entries.select("words", "frag", own_features().alias("own"), "indices", "phrase_n").where("words is not null")
    table = entries.select(F.array_join("words", " ").alias("phrase"), F.struct("*").alias("entry")).toArrow()
    given, by = table["entry"].combine_chunks(), {}
    for k, phrase in enumerate(table["phrase"].to_pylist()):
        by.setdefault(phrase, []).append(k)
    sent = s.sparkSession.sparkContext.broadcast((given, by))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), *entries.schema.fields])))
    def found(words: pa.Array) -> pa.Array:
        return spans.matches(words, sizes, *sent.value)

    return (s if every else s.where("sent_id is not null")).withColumn("candidates", F.sort_array(found("sent_words")))


def flat(rows_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates: sent_id, k, start, stop, words, frag) and (their features: sent_id, k, feature, value) of ``candidate_rows``."""
    every = rows_.select("sent_id", F.inline("candidates"))
    return every.drop("features"), every.select("sent_id", "k", F.inline("features"))


def few(weights: DataFrame | None) -> dict[str, float] | None:
    """Weights by feature, if they are few enough to be sent to each sentence; else none."""
    if weights is None:
        return {}
    w = weights.where("feature is not null and value is not null").groupBy("feature").agg(F.sum("value").alias("w")).limit(decoding.SENT + 1).collect()
    return dict(map(tuple, w)) if len(w) <= decoding.SENT else None


def of_candidates(*names: str) -> list[Column]:
    return [F.col("candidates")[x] for x in names]


def covered_rows(rows_: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``candidate_rows`` with ``chosen``: k and score of the cover's candidates, found where the sentence is."""
    sent = rows_.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(spans.CHOSEN)
    def cover(start: pa.Array, stop: pa.Array, frag: pa.Array, features: pa.Array) -> pa.Array:
        return spans.best_cover(start, stop, frag, features, sent.value)

    return rows_.withColumn("chosen", cover(*of_candidates("start", "stop", "frag", "features")))


def scored(found: DataFrame, features: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Candidates with ``score``, the weights of all their features added up."""
    if weights is None:
        return found.withColumn("score", F.lit(0.0))
    w = weights.groupBy("feature").agg(F.sum("value").alias("w"))
    total = features.join(decoding.small(w), "feature").groupBy("sent_id", "k").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    return found.join(total, ["sent_id", "k"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def chosen_candidates(rows_: DataFrame) -> DataFrame:
    """The chosen candidates of ``covered_rows`` with their score, one row each."""
    picked = F.transform("chosen", lambda x: F.struct(x["score"].alias("score"), F.get("candidates", x["k"]).alias("c")))
    return rows_.select("sent_id", F.inline(picked)).select("sent_id", "c.*", "score").drop("features")


def best_cover(candidates_: DataFrame) -> DataFrame:
    """The chosen candidates with their score."""
    kept = decoding.best_spans(candidates_.select("sent_id", "start", "stop", "frag", "score"))
    return kept.join(candidates_.drop("score"), ["sent_id", "start", "stop", "frag"])


def spans_of(sentences: DataFrame, knowledge: Knowledge, settings: Settings) -> DataFrame:
    """(sent_id, start, stop, words, frag, score): stage 1 alone, a cover of each sentence."""
    s1 = settings.stage1
    every, weights = candidate_rows(sentences, knowledge, s1), few(knowledge.weights1)
    if weights is None:
        return best_cover(scored(*flat(cut(every)), knowledge.weights1)).select("sent_id", "start", "stop", "words", "frag", "score")
    return chosen_candidates(covered_rows(every, weights)).select("sent_id", "start", "stop", "words", "frag", "score")


# Stage 2 -----------------------------------------------------------------------------------------

NODES = "sent_id long, nodes array<struct<id:string,concept:string,span:int,start:int,stop:int,frag_head:string,var:string>>, fixed array<struct<src:string,label:string,dst:string>>, spans array<struct<start:int,stop:int,nodes:array<string>>>, error string"


@lru_cache(4096)
def fragment(text: str):
    """The graph of a fragment's text; a task remembers those that it has read."""
    return penman.read(text, gorn=False)


def fragments(spans) -> tuple[list, list, list]:
    """(nodes, edges inside fragments, spans) of a sentence's cover: ids count up, variables are free names.

    Constants have no variable, but a span of constants alone gives its first node one, after the first character
    that is not a quotation mark: edges are between nodes with variables, so it could not be attached without.
    """
    nodes, fixed, out, taken = [], [], [], set()

    def name(initial: str) -> str:
        var = penman.free_name(initial, taken)
        taken.add(var)
        return var

    for k, (start, stop, frag) in enumerate(sorted(spans, key=lambda s: -s[0])):
        root, own, edges = fragment(frag)
        ids = {at: str(len(nodes) + i) for i, at in enumerate(own)}
        bare = all(concept[0] in '"-' for _, concept in own.values())
        for at, (_, concept) in own.items():
            var = name(concept[0].lower()) if concept[0] not in '"-' else name((concept.strip('"') or "x")[0]) if bare and at == root else None
            nodes.append((ids[at], concept, k, start, stop, own[root][1], var))
        for a, label, b, _ in edges:
            a, b = ids[a], ids[b]
            fixed.append((b, label[:-3], a) if label.endswith("-of") else (a, label, b))
        out.append((start, stop, list(ids.values())))
    return nodes, fixed, out


def concept_graphs(cover: DataFrame) -> DataFrame:
    """A sentence's nodes, fragment edges and spans; why its fragments could not be read is in ``error``."""
    gathered = cover.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "frag"))).alias("cells"))

    def run(batches):
        for pdf in batches:
            found = []
            for sent, cells in zip(pdf.sent_id, pdf.cells):
                try:
                    found.append((sent, *fragments([(c["start"], c["stop"], c["frag"]) for c in cells]), None))
                except Exception as e:
                    found.append((sent, [], [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(found, columns=["sent_id", "nodes", "fixed", "spans", "error"])

    return gathered.mapInPandas(run, NODES)


GRAPH = NODES.replace("sent_id long, ", "")
NODE_KINDS = [(x, pa.int32() if x in ("span", "start", "stop") else pa.string()) for x in ("id", "concept", "span", "start", "stop", "frag_head", "var")]
FIXED_KINDS = [(x, pa.string()) for x in ("src", "label", "dst")]
SPAN_KINDS = [("start", pa.int32()), ("stop", pa.int32()), ("nodes", pa.list_(pa.string()))]


def graph_of_cells() -> Callable:
    """``concept_graphs`` for a column of cells: an Arrow function that gives nodes, fixed, spans and error as one struct."""

    @F.arrow_udf(T._parse_datatype_string(f"struct<{GRAPH.replace(' array', ':array').replace(' string', ':string')}>"))
    def made(cells: pa.Array) -> pa.Array:
        found = []
        for row in cells.to_pylist():
            try:
                found.append((*fragments([(c["start"], c["stop"], c["frag"]) for c in row or ()]), None))
            except Exception as e:
                found.append(([], [], [], f"{type(e).__name__}: {e}"))
        nodes, fixed, spans_, errors = zip(*found) if found else ((), (), (), ())
        parts = [pairscores.lists(nodes, NODE_KINDS), pairscores.lists(fixed, FIXED_KINDS), pairscores.lists(spans_, SPAN_KINDS), pa.array(errors, pa.string())]
        return pa.StructArray.from_arrays(parts, names=["nodes", "fixed", "spans", "error"])

    return made


LAYERS = ("words", "pos", "rels", "heads", "srl")


def edge_rows(graphs: DataFrame, sentences: DataFrame, names) -> DataFrame:
    """Features of each ordered pair of named nodes (see ``edgefeatures.edge_features``)."""
    named = graphs.select("sent_id", F.filter("nodes", lambda n: n["var"].isNotNull()).alias("nodes"))
    return edgefeatures.edge_features(sentences.select("sent_id", *LAYERS).join(named, "sent_id"), names)


def root_rows(graphs: DataFrame, sentences: DataFrame, names) -> DataFrame:
    """Features of each named node as a root."""
    named = graphs.select("sent_id", F.filter("nodes", lambda n: n["var"].isNotNull()).alias("nodes"))
    return edgefeatures.root_features(sentences.select("sent_id", *LAYERS).join(named, "sent_id"), names)


def edge_scores(graphs: DataFrame, features: DataFrame, labels: DataFrame, weights: DataFrame, decoder: str, costs: DataFrame | None = None) -> DataFrame:
    """(sent_id, scores): the labels and scores of each ordered pair of named nodes.

    For decoders that look at the best label only, a pair has one; ties go to the smaller label. ``costs`` are
    weights that hold in one sentence only (sent_id, feature, label, value).
    """
    nodes = graphs.select("sent_id", F.explode(F.filter("nodes", lambda n: n["var"].isNotNull())["id"]).alias("node_id"))
    scores = decoding.pair_scores(nodes, labels, features, weights, costs)
    if decoder in BEST_ONLY:
        best = F.min(F.struct((-F.col("score")).alias("below"), "label", "score"))
        scores = scores.groupBy("sent_id", "src", "dst").agg(best.alias("b")).select("sent_id", "src", "dst", "b.label", "b.score")
    return scores.groupBy("sent_id").agg(F.collect_list(F.struct("src", "dst", "label", "score")).alias("scores"))


def root_scores(features: DataFrame, weights: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """(sent_id, root_scores): a map of each node's score as the root, for nodes that meet a weight."""
    met = features.join(decoding.small(weights.where("label is null").select("feature", "value")), "feature").select("sent_id", "node_id", (F.col("u") * F.col("value")).alias("s"))
    if costs is not None:
        own = costs.where("label is null").select("sent_id", "feature", "value")
        met = met.unionByName(features.join(own, ["sent_id", "feature"]).select("sent_id", "node_id", (F.col("u") * F.col("value")).alias("s")))
    return met.groupBy("sent_id", "node_id").agg(F.sum("s").alias("s")).groupBy("sent_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "s"))).alias("root_scores"))


def sums_of(weights: DataFrame, labels: DataFrame) -> pairscores.Sums | None:
    """The weights and labels, if the weights are few enough to be sent to each sentence; else none."""
    found = weights.where("feature is not null and value is not null").select("feature", "label", "value").limit(decoding.SENT + 1).collect()
    if len(found) > decoding.SENT:
        return None
    by_label = labels.select("label", decoding.label_group(F.col("label")).alias("group")).distinct().orderBy("label").collect()  # a label set is short
    return pairscores.Sums(list(map(tuple, found)), list(map(tuple, by_label)))


def in_sentences(rows_: DataFrame, keep, edge_names, root_names, sums: pairscores.Sums, best: bool, made: Callable, schema) -> DataFrame:
    """What ``made`` gives for the scored graphs of ``rows_``, sentences with their layers, nodes and the columns to keep.

    A sentence's pairs are scored and put together where it is: nothing is dealt out or joined. ``made`` takes what is kept
    (an Arrow struct array), the scores of roots and the scored edges of many sentences, and gives a batch of ``schema``.
    """
    named = rows_.select("sent_id", *LAYERS, F.filter("nodes", lambda n: n["var"].isNotNull()).alias("nodes"), F.struct(*keep).alias("given"))
    pairs, sent = edgefeatures.pair_items(named, edge_names, root_names), rows_.sparkSession.sparkContext.broadcast(sums)

    def run(batches):
        for given, roots, edges in pairscores.sentences(batches, sent.value, best):
            yield made(given, roots, edges)

    return pairs.mapInArrow(run, schema)


#: Decoders: a function of the stage's settings gives a function of (named nodes, fixed edges, scores, label limits).
DECODERS: dict[str, Callable] = {
    "Alg1": lambda s: edgedecode.top_labels,
    "Alg1a": lambda s: edgedecode.top_labels,
    "Alg2": lambda s: lambda nodes, fixed, scores, limits: edgedecode.connected_subgraph(nodes, fixed, scores, s.connected),
    "Greedy": lambda s: edgedecode.greedy,
    "LR": lambda s: lambda nodes, fixed, scores, limits: edgedecode.relaxed(nodes, fixed, scores, limits, s.iterations, s.step, s.strategy, edgedecode.greedy if s.approximate else None, s.connected)[0],
}
#: Those that look at the best label of a pair only.
BEST_ONLY = {"Alg2", "Greedy"}


def decoder_of(settings) -> Callable:
    """The stage's decoder. Looked up on the driver and sent with the work, so that one that was registered there is known."""
    return DECODERS[settings.decoder](settings)


def decode(nodes, fixed, scores, roots, limits, decoder: Callable, and_root: bool = False) -> tuple[str, list, bool]:
    """(root, edges with their scores, whether an ``and`` node was put on top) of a sentence; edges in fragments score 0.

    With ``and_root`` the parts of a graph in parts go below an ``and`` node. Else the root is the node with the best root score among named ones that are no constants; ties go to the first.
    """
    concept, var = {n["id"]: n["concept"] for n in nodes}, {n["id"]: n["var"] for n in nodes}
    named = [n["id"] for n in nodes if n["var"] is not None]
    inner = [(e["src"], e["dst"], e["label"], 0.0) for e in fixed]
    between = [e for e in inner if var[e[0]] is not None and var[e[1]] is not None]
    found = decoder(named, between, scores, limits) if named else []
    rest = [e for e in inner if e not in between]
    if and_root:
        top, joined = edgedecode.with_and_root(named, found, roots)
        if top == "and":
            return top, [*rest, *joined], True
    return best_root(named, concept, roots), [*rest, *found], False


def best_root(named, concept, roots) -> str:
    free = [n for n in named if not penman.is_constant(concept[n])]
    return max(free, key=lambda n: (roots.get(n, 0.0), -int(n))) if free else named[0]


@dataclass
class Graph:
    """A decoded graph in the order in which it is printed: Gorn ids, variables, tree and re-entrant edges.

    A graph in parts has a root for each: 0, 1, ...; whole graphs have one.
    """

    roots: list[str]
    nodes: dict[str, tuple[str | None, str]]
    edges: list[tuple[str, str, str, str]]
    spans: list[tuple[int, int, list[str]]] = field(default_factory=list)

    def text(self) -> str:
        """The parts as PENMAN, one below the other."""
        return "\n".join(penman.show((r, self.nodes, self.edges), 1) for r in self.roots)


def assembled(nodes, fixed, spans, scores, roots, limits, settings: Settings, decoder: Callable | None = None) -> Graph:
    """Decodes the edges, takes spanning trees, numbers ``:op`` children, sorts relations and gives Gorn ids.

    What the root does not reach is not lost: each further part has its own best root and is numbered after the others.
    """
    top, edges, on_top = decode(nodes, fixed, scores, roots, limits, decoder or decoder_of(settings.stage2), settings.stage2.decoder == "Alg1a")
    concept, var, start = {n["id"]: n["concept"] for n in nodes}, {n["id"]: n["var"] for n in nodes}, {n["id"]: n["start"] for n in nodes}
    if on_top:
        concept["and"], var["and"] = "and", penman.free_name("a", {v for v in var.values() if v})
    turned = {":mod-of": ":domain", ":domain-of": ":mod"} if settings.normalize_mod else {}
    plain = [(a, label, b) for a, b, label, _ in edges]
    gorn, order, out, tops = {}, [], [], []
    while top is not None:
        tree, again = penman.spanning_tree(top, plain)
        children: dict[str, list] = {}
        for a, label, b in tree:
            children.setdefault(a, []).append((label, b))
        gorn[top] = str(len(tops))
        tops.append(gorn[top])
        part = [top]
        for a in part:
            for i, (label, b) in enumerate(sorted(penman.numbered_ops(children.get(a, []), start), key=lambda e: e[0])):
                gorn[b] = f"{gorn[a]}.{i}"
                out.append((gorn[a], turned.get(label, label), gorn[b], "tree"))
                part.append(b)
        out += [(gorn[a], label, gorn[b], "reentrant") for a, label, b in again]
        order += part
        left = [n["id"] for n in nodes if n["id"] not in gorn]
        top = best_root([n for n in left if var[n] is not None] or left, concept, roots) if left else None
    return Graph(tops, {gorn[n]: (var[n], concept[n]) for n in order}, out, [(s["start"], s["stop"], sorted(gorn[n] for n in s["nodes"])) for s in spans])


def written(graph: Graph, snt: str, tok: str, output, annotator: str, text: str | None = None) -> str:
    """The block of a sentence: its text, tokens, alignments and the forms asked for; ``text`` is the graph's, if it is there."""
    spans = " ".join(f"{a}-{b}|{'+'.join(ids)}" for a, b, ids in graph.spans if a < b and ids)
    lines = [f"# ::snt {snt}", f"# ::tok {tok}", f"# ::alignments {spans} ::annotator {annotator}"]
    at = {n: f"{a}-{b}" for a, b, ids in graph.spans for n in ids}
    forms = {
        "nodes": lambda: sorted(f"{k}\t{c}\t{at.get(k, '')}" for k, (_, c) in graph.nodes.items()),
        "root": lambda: [f"{r}\t{graph.nodes[r][1]}" for r in graph.roots],
        "edges": lambda: sorted(f"{graph.nodes[a][1]}\t{label.lstrip(':')}\t{graph.nodes[b][1]}\t{a}\t{b}\t" for a, label, b, _ in graph.edges),
    }
    names = {"nodes": "# ::node\t", "root": "# ::root\t", "edges": "# ::edge\t"}
    for form in ("nodes", "root", "edges"):
        if form in output:
            lines += [names[form] + x for x in forms[form]()]
    if "AMR" in output:
        lines.append(graph.text() if text is None else text)
    if "triples" in output:
        name = lambda k: (f"{graph.nodes[k][0]} / " if graph.nodes[k][0] else "") + graph.nodes[k][1]
        lines += sorted(f"({name(a)}, {label.lstrip(':')}, {name(b)})" for a, label, b, _ in graph.edges)
    if "disconnectedAMR" in output:
        for k, (var, concept) in graph.nodes.items():
            if var is not None:
                below = [f"  {label} {graph.nodes[b][0] or graph.nodes[b][1]}" for a, label, b, _ in graph.edges if a == k]
                lines.append("\n".join([f"({var} / {concept}", *below]) + ")")
    return "\n".join(lines) + "\n"


SCORES = "array<struct<src:string,dst:string,label:string,score:double>>"
OUT = "sent_id long, graph string, alignments string, block string, error string"


def scored_graphs(graphs: DataFrame, sentences: DataFrame, knowledge: Knowledge, settings: Settings) -> DataFrame:
    """``graphs`` with scores and root_scores; null where stage 2 is off or has no weights."""
    s2 = settings.stage2
    if settings.stage1.only or knowledge.weights2 is None or knowledge.labels is None:
        none = {"scores": SCORES, "root_scores": "map<string,double>"}
        return graphs.withColumns({k: F.lit(None).cast(v) for k, v in none.items()})
    edge_names, root_names = [x for x in s2.features if x in edgefeatures.EDGE], [x for x in s2.features if x in edgefeatures.ROOT]
    out = graphs.join(edge_scores(graphs, edge_rows(graphs, sentences, edge_names), knowledge.labels, knowledge.weights2, s2.decoder), "sent_id", "left")
    if not root_names:
        return out.withColumn("root_scores", F.lit(None).cast("map<string,double>"))
    return out.join(root_scores(root_rows(graphs, sentences, root_names), knowledge.weights2), "sent_id", "left")


def limits_of(labels: DataFrame | None) -> dict[str, int]:
    return {r["label"]: r["max_card"] for r in labels.collect()} if labels is not None else {}  # a label set is short


def parse(sentences: DataFrame, knowledge: Knowledge, settings: Settings = Settings(), annotator: str = "graphloom", gold: DataFrame | None = None) -> DataFrame:
    """(sent_id, graph, alignments, block, error) of every sentence; ``settings`` says which sources, features and decoder.

    A sentence without a cover, or one that fails where ``settings.ignore_errors`` is set, has the empty graph; a
    failure is told in ``error``, and without that setting fails the query. With ``settings.stage1.oracle`` the
    spans are those of ``gold`` (sent_id, start, stop, frag). A graph in parts (stage 1 only, no weights, Alg1) has
    all of them, one below the other.
    """
    rows_ = graph_rows(sentences, knowledge, settings, gold)
    limits, decoder, s2 = limits_of(knowledge.labels), decoder_of(settings.stage2), settings.stage2

    def one(sent, snt, tok, row, scores, roots):
        try:
            if row["error"]:
                raise penman.PenmanError(row["error"])
            if not row["nodes"]:
                graph = Graph(["0"], {"0": ("a", "amr-empty")}, [], [(0, 1, ["0"])])
            else:
                graph = assembled(row["nodes"], row["fixed"], row["spans"], scores, roots, limits, settings, decoder)
            at = " ".join(f"{a}-{b}|{'+'.join(ids)}" for a, b, ids in graph.spans if ids)
            text = graph.text()
            return sent, text, at, written(graph, snt, tok, settings.output, annotator, text), None
        except Exception as e:
            if not settings.ignore_errors:
                raise
            block = f"# ::snt {snt}\n# ::tok {tok}\n# ::alignments {EMPTY_SPAN} ::annotator {annotator}\n# {type(e).__name__} in the parser; this graph is empty.\n{EMPTY}\n"
            return sent, EMPTY, EMPTY_SPAN, block, f"{type(e).__name__}: {e}"

    def made(given, roots, scores):
        rows = [one(r["sent_id"], " ".join(r["snt"]), " ".join(r["words"]), r["graph"], s, t) for r, s, t in zip(given.to_pylist(), scores, roots)]
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], given.field("sent_id").type), *(pa.array(c, pa.string()) for c in columns[1:])], names=["sent_id", "graph", "alignments", "block", "error"])

    keep = ["sent_id", "snt", "words", "graph"]
    schema = T.StructType([rows_.schema["sent_id"], *T._parse_datatype_string(OUT).fields[1:]])
    scored_ = not settings.stage1.only and knowledge.weights2 is not None and knowledge.labels is not None
    sums = sums_of(knowledge.weights2, knowledge.labels) if scored_ else None
    if sums is not None:
        names = [[x for x in s2.features if x in table] for table in (edgefeatures.EDGE, edgefeatures.ROOT)]
        return in_sentences(rows_.withColumn("nodes", F.col("graph.nodes")), keep, *names, sums, s2.decoder in BEST_ONLY, made, schema)
    if scored_:
        rows_ = cut(rows_)
        graphs = rows_.select("sent_id", "graph.nodes")
        tables = scored_graphs(graphs, sentences, knowledge, settings).select("sent_id", "scores", "root_scores")
        rows_ = rows_.join(tables, "sent_id", "left")
    else:
        rows_ = rows_.withColumns({"scores": F.lit(None).cast(SCORES), "root_scores": F.lit(None).cast("map<string,double>")})

    def run(batches):
        for batch in batches:
            given = pa.StructArray.from_arrays([batch.column(x) for x in keep], names=keep)
            scores = [[(e["src"], e["dst"], e["label"], e["score"]) for e in r or ()] for r in batch.column("scores").to_pylist()]
            yield made(given, [dict(r or ()) for r in batch.column("root_scores").to_pylist()], scores)

    return rows_.select(*keep, "scores", "root_scores").mapInArrow(run, schema)


def graph_rows(sentences: DataFrame, knowledge: Knowledge, settings: Settings, gold: DataFrame | None = None) -> DataFrame:
    """(sent_id, snt, layers, graph): every sentence with the nodes, fixed edges and spans of its cover, made in its row where
    stage 1's weights are few."""
    s1, layers = settings.stage1, ["snt", *LAYERS]
    weights = None if s1.oracle else few(knowledge.weights1)
    if weights is not None:
        given = sentences.withColumn("given", F.struct(*layers))
        rows_ = covered_rows(candidate_rows(given, knowledge, s1, ["given"], every=True), weights)
        cell = lambda x: (lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["frag"].alias("frag")))(F.get("candidates", x["k"]))
        rows_ = rows_.select("sent_id", *(F.col(f"given.{x}") for x in layers), F.sort_array(F.transform("chosen", cell)).alias("cells"))
    else:
        cover = gold if s1.oracle else spans_of(sentences, knowledge, settings)
        cells = cover.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "frag"))).alias("cells"))
        rows_ = sentences.select("sent_id", *layers).join(cells, "sent_id", "left")
    return rows_.select("sent_id", *layers, graph_of_cells()("cells").alias("graph"))
