"""Line dedup over overlapping three-line windows, in DataFrame operations.

Lines are hashed, windows of consecutive lines are counted globally, and every occurrence of a repeated
window but the first marks its lines; what overlapping windows mark is merged and removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import without, words_of

WINDOW = 3


def dedup_lines(df: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW, words: int | None = None) -> DataFrame:
    """``df`` with repeated passages cut out of ``text``, and ``n_lines`` and ``n_removed``.

    Lines are split at line feeds. A window is ``window`` consecutive lines; a text of fewer lines is one window.
    Occurrences are ordered by (id with nulls last, text hash, line), and the first of each window stays.
    A line is removed if a later occurrence of any window covers it; the first occurrence of a line in that
    order is never covered, so each distinct line survives at least once. A text of which nothing is left
    becomes an empty one and its row stays. Repeated rows (same id and text) are one document and are treated alike. Null
    texts stay null, with no lines; an empty text has one empty line. Columns ``n_lines`` and ``n_removed``
    of the input are replaced. Windows are compared by two 64-bit hashes of different seeds.
    With ``words``, each run of fewer lines that holds more words than that is a window as well, wherever it stands.
    """
    kept = without(df, ("n_lines", "n_removed"))
    docs = df.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept if c != text)).alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.withColumn("of", F.xxhash64("text"))
    lines = docs.where("text is not null").select("id", "of", F.split("text", "\n").alias("lines"))
    hashed = lines.select("id", "of", F.size("lines").alias("n"), F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), *([] if words is None else [F.size(words_of(x)).alias("w")]))).alias("h"))

    def windows(size: int, starts: str) -> str:
        get = ", ".join(f"get(h, i + {k}).{{0}}" for k in range(size))
        return f"transform({starts}, i -> named_struct('at', i, 'len', {size}, 'a', xxhash64({get.format('a')}), 'b', xxhash64(2, {get.format('b')})))"

    every = [windows(window, f"sequence(0, greatest(0, n - {window}))")]
    for size in range(1, window) if words is not None else ():
        held = " + ".join(f"get(h, i + {k}).w" for k in range(size))
        every.append(windows(size, f"filter(sequence(0, greatest(0, n - {size})), i -> {held} > {words})"))
    at = F.expr(f"inline(concat({', '.join(every)}))")
    places = hashed.select("id", "of", at)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "of", "at")
    repeated = places.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Joined on another form of the hash, so that both sides are dealt anew and a very common window can be split.
    later = places.withColumn("k", F.col("a").bitwiseXOR(F.col("b"))).join(repeated.select(F.col("a").bitwiseXOR(F.col("b")).alias("k"), F.col("b").alias("b2"), "first"), "k")
    later = later.where((F.col("b") == F.col("b2")) & (order != F.col("first")))
    marked = later.groupBy("id", "of").agg(F.collect_set(F.struct("at", "len")).alias("at"))
    marked = marked.select(F.xxhash64("id", "of").alias("k"), F.col("id").alias("id2"), F.col("of").alias("of2"), "at")
    found = docs.withColumn("k", F.xxhash64("id", "of")).alias("d").join(marked.alias("m"), F.expr("d.k = m.k and d.of = m.of2 and d.id <=> m.id2"), "left").select("d.row", "d.text", "m.at")
    # Only texts that lose lines are taken apart; the others' line feeds are counted as bytes.
    n = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)
    found = found.withColumn("gone", F.expr("flatten(transform(at, x -> sequence(x.at, x.at + x.len - 1)))")).withColumn("n", n)
    found = found.withColumn("kept", F.when(F.col("gone").isNotNull(), F.expr("array_except(sequence(0, n - 1), gone)")))
    cut = F.expr(r"if(kept is null, text, array_join(transform(array(split(text, '\n')), ls -> array_join(transform(kept, i -> get(ls, i)), '\n')), ''))")
    new = found.select("row", cut.alias("new"), F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.when(F.col("kept").isNull(), F.col("n")).otherwise(F.size("kept"))).cast("long").alias("n_removed"))
    return new.select(*((F.col("new") if c == text else F.col("row")[c]).alias(c) for c in kept), "n_lines", "n_removed")
