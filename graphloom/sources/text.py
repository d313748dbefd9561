"""Readers of the text formats: blocks, metadata, annotation layers, dictionaries, weights.

All are projections over one text column, so they prune, push down and run inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, block_no, block): parts of a text between blank lines; runs of blank lines count as one."""
    parts = F.filter(F.split(F.col(text), r"\n\n+"), lambda b: b != "")
    return df.select(F.col(id), F.posexplode(parts).alias("block_no", "block"))


def graph_blocks(df: DataFrame) -> DataFrame:
    """Blocks with a line that starts a graph."""
    return df.where(F.col("block").rlike(r"(?m)^\("))


def metadata(line: Column) -> Column:
    """``# ::key value ::key2 value2`` as a map; a key without a value has the empty string."""
    parts = F.filter(F.split(F.regexp_replace(line, r"^# *", " "), " ::"), lambda p: F.trim(p) != "")
    pair = lambda p: F.struct(F.concat(F.lit("::"), F.split(p, " ")[0]).alias("k"), F.trim(F.regexp_replace(p, r"^[^ ]* ?", "")).alias("v"))
    return F.map_from_entries(F.transform(parts, pair))


def record(block: Column) -> Column:
    """A training record of a block: graph lines, the tokens, all alignments and the one in force (the last).

    ``bad`` says that the block has not exactly one ``::tok`` or no ``::alignments``.
    """
    lines = F.split(block, "\n")
    meta = F.filter(lines, lambda x: x.startswith("#"))
    pick = lambda key: F.transform(F.filter(meta, lambda x: x.contains(f"::{key} ")), lambda x: F.trim(F.regexp_extract(x, rf"::{key} (.*?)(?: ::|$)", 1)))
    aligned = pick("alignments")
    return F.struct(
        F.array_join(F.filter(lines, lambda x: ~x.startswith("#")), "\n").alias("graph"),
        F.get(pick("tok"), F.lit(0)).alias("tok"),
        aligned.alias("alignments"),
        F.when(F.size(aligned) > 0, F.element_at(aligned, -1)).alias("alignment"),
        ((F.size(pick("tok")) != 1) | (F.size(aligned) == 0)).alias("bad"),
    )


def dependencies(df: DataFrame, id: str, block: str) -> DataFrame:
    """CoNLL-X rows (idx, form, pos, head, rel), 0-based; the head of the root is -1."""
    lines = df.select(F.col(id), F.posexplode(F.filter(F.split(F.col(block), "\n"), lambda x: x != "")).alias("idx", "line"))
    c = F.split("line", "\t")
    return lines.select(id, "idx", c[1].alias("form"), c[4].alias("pos"), (c[6].cast("int") - 1).alias("head"), c[7].alias("rel"))


def typed_dependency(text: Column) -> Column:
    """``rel(head-3, dependent-5)`` as (rel, head, dependent), 0-based."""
    at = lambda g: F.regexp_extract(text, r"^(.*)\((.*)-([0-9]+)'*, (.*)-([0-9]+)'*\)$", g)
    return F.struct(at(1).alias("rel"), (at(3).cast("int") - 1).alias("head"), (at(5).cast("int") - 1).alias("dependent"))


def entities(df: DataFrame, id: str, idx: str, tag: str) -> DataFrame:
    """(id, start, stop, label): maximal runs of BIO or BILOU tags.

    A run starts at any tag but O and goes on over I- and L- tags of its label.
    """
    w = Window.partitionBy("__id").orderBy("__idx")
    given = df.select(F.col(id).alias("__id"), F.col(idx).alias("__idx"), F.col(tag).alias("__tag"))
    on = F.col("__tag").rlike("^[IL]-") & (F.substring("__tag", 3, 2**30) == F.substring(F.lag("__tag").over(w), 3, 2**30)) & (F.lag("__tag").over(w) != "O")
    runs = given.withColumn("__new", F.when((F.col("__tag") == "O") | F.coalesce(on, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("__run", F.sum("__new").over(w)).where("__tag <> 'O'")
    found = runs.groupBy("__id", "__run").agg(F.min("__idx").alias("start"), (F.max("__idx") + 1).alias("stop"), F.first(F.substring("__tag", 3, 2**30)).alias("label"))
    return found.select(F.col("__id").alias(id), "start", "stop", "label")


def bracket_tags(text: Column) -> Column:
    """``[PER John Smith] spoke`` as an array of (token, tag), by one pass over the tokens."""
    tokens = F.filter(F.split(text, " +"), lambda t: t != "")
    none = F.from_json(F.lit("[]"), "array<struct<token:string,tag:string>>")
    start = F.struct(F.lit("").alias("label"), F.lit(False).alias("first"), none.alias("out"))

    def merge(z, t):
        opens, inside = t.rlike(r"^\[[A-Z]+$"), z["label"] != ""
        item = F.struct(F.regexp_replace(t, r"\]$", "").alias("token"), F.concat(F.when(z["first"], "B-").otherwise("I-"), z["label"]).alias("tag"))
        plain = F.struct(t.alias("token"), F.lit("O").alias("tag"))
        return F.struct(
            F.when(opens, F.substring(t, 2, 1000)).when(inside & ~t.endswith("]"), z["label"]).otherwise("").alias("label"),
            opens.alias("first"),
            F.when(opens, z["out"]).when(inside, F.concat(z["out"], F.array(item))).otherwise(F.concat(z["out"], F.array(plain))).alias("out"),
        )

    return F.aggregate(tokens, start, merge, lambda z: z["out"])


def predicate_arguments(df: DataFrame, id: str, line: str) -> DataFrame:
    """``V:4-5 AM-TMP:0-3`` as rows (pred_start, pred_stop, arg, arg_start, arg_stop)."""
    at = lambda x, g: F.regexp_extract(x, r"^(.*):([0-9]+)-([0-9]+)$", g)
    parts = F.split(F.col(line), " ")
    rows = df.select(F.col(id), parts[0].alias("p"), F.explode(F.slice(parts, 2, F.size(parts))).alias("a"))
    return rows.select(id, at(F.col("p"), 2).cast("int").alias("pred_start"), at(F.col("p"), 3).cast("int").alias("pred_stop"), at(F.col("a"), 1).alias("arg"), at(F.col("a"), 2).cast("int").alias("arg_start"), at(F.col("a"), 3).cast("int").alias("arg_stop"))


def concept_row(line: Column) -> Column:
    """``words ||| frag ||| k=v ... ||| idx ...``; the indices may be absent."""
    f = F.split(line, r" *\|\|\| *")
    pairs = F.transform(F.filter(F.split(f[2], " "), lambda x: x != ""), lambda x: F.struct(F.regexp_replace(x, "=[^=]*$", "").alias("k"), F.regexp_extract(x, "=([^=]*)$", 1).cast("double").alias("v")))
    indices = F.transform(F.filter(F.split(F.coalesce(F.get(f, F.lit(3)), F.lit("")), " "), lambda x: x != ""), lambda x: x.cast("int"))
    return F.struct(F.split(f[0], " ").alias("words"), f[1].alias("frag"), F.map_from_entries(pairs).alias("features"), indices.alias("training_indices"))


def phrase_count(line: Column) -> Column:
    """``word ... count``: the last field is the count."""
    f = F.split(line, " ")
    return F.struct(F.slice(f, 1, F.size(f) - 1).alias("words"), F.element_at(f, -1).cast("int").alias("n"))


def weight(line: Column, labels: list[str] | None = None) -> Column:
    """``feature[+L=label]<space or tab>value``; without a label the weight is unconjoined (null).

    Only what is in ``labels`` is a label, or without them what starts with a colon: the ``+L=<ROOT>`` of root
    features belongs to their name.
    """
    at = lambda g: F.regexp_extract(line, r"^(.+?)(?:\+L=([^ \t]+))?[ \t]([^ \t]+)$", g)
    known = at(2).isin(*labels) if labels is not None else at(2).startswith(":")
    whole = F.when(at(2) != "", F.concat(at(1), F.lit("+L="), at(2))).otherwise(at(1))
    return F.struct(F.when(known, at(1)).otherwise(whole).alias("feature"), F.when(known, at(2)).alias("label"), at(3).cast("double").alias("value"))


def label_limit(line: Column) -> Column:
    """``:label [max]``: how many edges of a label a node may have; 1000 if not said."""
    f = F.split(line, " +")
    return F.struct(f[0].alias("label"), F.coalesce(F.get(f, F.lit(1)).try_cast("int"), F.lit(1000)).alias("max_card"))


def unescape_brackets(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("-LRB-"), F.lit("(")), F.lit("-RRB-"), F.lit(")")), F.lit("\\/"), F.lit("/"))


def sentence_of(line: Column) -> Column:
    """The sentence of a ``# ::snt`` line with runs of spaces collapsed; null for other lines."""
    return F.when(line.startswith("# ::snt "), F.regexp_replace(F.substring(line, 9, 2**30), "  +", " "))


def fold(block: Column) -> Column:
    return F.replace(block, F.lit("\n"), F.lit("\t"))


def unfold(line: Column) -> Column:
    return F.replace(line, F.lit("\t"), F.lit("\n"))


def zip_layers(layers: dict[str, DataFrame], id: str) -> DataFrame:
    """Annotation layers side by side by sentence id; raises if a layer lacks a sentence that another has.

    A layer's sentences are told by one exchange each, in which every id of every layer is counted.
    """
    names = list(layers)
    marked = [layers[n].select(F.col(id), F.lit(k).alias("layer")) for k, n in enumerate(names)]
    every = marked[0]
    for more in marked[1:]:
        every = every.unionByName(more)
    counts = every.groupBy(id).agg(*(F.sum((F.col("layer") == k).cast("int")).alias(f"n{k}") for k in range(len(names))))
    differ = counts.agg(*(F.max(F.when(F.col(f"n{k}") != F.col("n0"), 1).otherwise(0)).alias(f"d{k}") for k in range(len(names)))).first()
    for k, name in enumerate(names):
        if differ[f"d{k}"]:
            raise ValueError(f"layer {name} has other sentences than {names[0]}")
    out = layers[names[0]]
    for name in names[1:]:
        out = out.join(layers[name], id)
    return out


def tokens(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, idx, tok): parts of a text between spaces and line feeds."""
    return df.select(F.col(id), F.posexplode(F.filter(F.split(F.col(text), "[ \n]"), lambda t: t != "")).alias("idx", "tok"))
