"""Corpus tools over blocks of text: annotation, splits, format checks and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate(blocks: DataFrame, tokens: DataFrame, order: str) -> DataFrame:
    """Blocks with a ``# ::tok`` line after their leading ``#`` lines; ``tokens`` has the order column and ``tok``.

    A block without tokens stays as it is. Blocks and tokens meet by an explicit order, not by their place in a file.
    """
    joined = blocks.join(tokens.select(order, "tok"), order, "left")
    lines = F.split("block", "\n")
    meta = F.filter(lines, lambda x: x.startswith("#"))
    rest = F.filter(lines, lambda x: ~x.startswith("#"))
    made = F.array_join(F.concat(meta, F.array(F.concat(F.lit("# ::tok "), F.col("tok"))), rest), "\n")
    return joined.withColumn("block", F.when(F.col("tok").isNull(), F.col("block")).otherwise(made)).drop("tok")


def split_by_year(df: DataFrame, year: Column, dev: int, test: int) -> DataFrame:
    """Rows with ``split``: the years ``dev`` and ``test`` are held out, all others train."""
    return df.withColumn("split", F.when(year == dev, "dev").when(year == test, "test").otherwise("train"))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Several corpora as one, column by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Format problems of a graph's text: a name, and the condition on the text without quoted strings.
PROBLEMS = {
    "no graph": lambda t: ~t.rlike(r"\("),
    "brackets": lambda t: F.length(F.replace(t, F.lit("("))) != F.length(F.replace(t, F.lit(")"))),
    "empty brackets": lambda t: t.rlike(r"\(\s*\)"),
    "relation without value": lambda t: t.rlike(r":[A-Za-z][^\s()]*\s*(\)|:|$)"),
    "variable without concept": lambda t: t.rlike(r"/\s*(\)|:|$)"),
    "slash without spaces": lambda t: t.rlike(r"\([^\s()/]+/[^\s()]"),
    "quotes": lambda t: t.contains('"'),
}


def format_problems(graph: Column) -> Column:
    """The names of the format problems of a graph's text, in the order of ``PROBLEMS``; empty if it is fine."""
    bare = F.regexp_replace(graph, '"[^"\n]*"', "Q")
    return F.filter(F.array(*(F.when(test(bare), F.lit(name)) for name, test in PROBLEMS.items())), lambda x: x.isNotNull())


def listed_spans(spans: DataFrame) -> DataFrame:
    """(sent_id, listing): ``start-stop words => fragment`` of each span, by the lower-cased words."""
    line = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(" "), "words", F.lit(" => "), "frag")
    key = F.struct(F.lower("words").alias("k"), "start", "stop", line.alias("line"))
    return spans.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["line"]), "\n").alias("listing"))


def shuffled(df: DataFrame, key: Column, seed: int, parts: int = 64) -> DataFrame:
    """Rows with ``place`` (from 0, without gaps), a random order of all rows that depends on the seed and the key alone.

    Rows are dealt to ``parts`` by a hash, numbered there, and moved on by the rows of the parts before.
    """
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts))).withColumn("__order", F.xxhash64(F.lit(seed + 1), key)).withColumn("__key", key)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    # A row for each part.
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__order", "__key")) - 1
    placed = dealt.withColumn("inside", inside).join(F.broadcast(before), "__part")
    return placed.withColumn("place", F.col("before") + F.col("inside")).drop("__part", "__order", "__key", "before", "inside")


def tag_counts(tags: DataFrame, size: int) -> DataFrame:
    """(gram, n): how often each run of ``size`` tags stands in ``tags`` (sent_id, pos array)."""
    runs = F.when(F.size("pos") >= size, F.transform(F.sequence(F.lit(1), F.size("pos") - size + 1), lambda i: F.array_join(F.slice("pos", i, size), "_"))).otherwise(F.array().cast("array<string>"))
    return tags.select(F.explode(runs).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
