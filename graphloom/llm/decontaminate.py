"""Benchmark decontamination by a prefix-filtered join of shingles, in DataFrame operations only.

A window is ``size`` consecutive words of an item, or a shorter item's whole words. Its shingles are ordered by
how rare they are in the documents; since a window must be contained whole, its rarest shingle is prefix
enough. Documents' shingles are joined with those prefixes; a meeting gives the place where the window would have to
lie, which must lie inside the document (length and positional bounds). The words at that place are
then compared with the window's words, so nothing rests on hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, without, words_of

#: Words in a window, and in the shingles that windows are found by.
WINDOW, SHINGLE = 10, 4
#: Rows of a side that is broadcast, at most; a longer one is dealt out by key instead.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if it has few rows (of bounded width)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def windows_of(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct windows: ``wid``, their words, and the sorted ids (as strings) of the items that have them."""
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("words")).where("size(words) > 0")
    places = items.select("item", "words", F.explode(F.expr(f"sequence(1, greatest(1, size(words) - {window - 1}))")).alias("at"))
    spans = places.select("item", F.slice("words", F.col("at"), window).alias("words"))
    # An item without an id hits words but is not listed.
    return spans.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("wid", F.xxhash64("words"))


def shingles_sql(words: str, n: int) -> str:
    """SQL for the hashes of all shingles of ``n`` words, in their order."""
    parts = ", ".join(["w", *(f"get({words}, i + {k})" for k in range(1, n))])
    return f"transform(slice({words}, 1, greatest(0, size({words}) - {n - 1})), (w, i) -> xxhash64({parts}))"


def decontaminate(df: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with n_words, n_hit, n_items, items (sorted ids as strings) and contaminated (n_hit > 0).

    A word is hit if it lies inside any occurrence of a window. Null and empty texts have no words and are
    clean; so is everything if the benchmark has no words. Documents with a null id, equal ids and repeated
    rows are judged by their own texts. Columns named as an output are replaced. A benchmark item with a null id
    hits words but is not listed. Tables of any size work: the benchmark's shingles are broadcast
    only while they have at most ``BROADCAST_ROWS`` rows, else both sides are dealt by shingle.
    """
    kept = without(df, ("n_words", "n_hit", "n_items", "items", "contaminated"))
    docs = df.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept if c != text)).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    # Copies of a text are one document here. Two texts of one hash would only be offered each other's spans.
    docs = docs.withColumn("of", F.xxhash64("text"))
    windows = cut(windows_of(benchmark, item, item_text, window))
    grams = windows.withColumn("n", F.least(F.size("words"), F.lit(shingle)))
    lengths = sorted(r[0] for r in grams.select("n").distinct().collect())  # 1 to ``shingle``
    tokens = None
    for n in lengths:
        of = grams.where(F.col("n") == n).select("wid", "n", F.size("words").alias("length"), F.posexplode(F.expr(shingles_sql("words", n))).alias("offset", "token"))
        tokens = of if tokens is None else tokens.unionByName(of)
    places = None
    for n in lengths:
        at = docs.select("of", words_of(F.col("text")).alias("words"))
        at = at.select("of", F.size("words").alias("n_words"), F.lit(n).alias("n"), F.posexplode(F.expr(shingles_sql("words", n))).alias("at", "token"))
        places = at if places is None else places.unionByName(at)
    if tokens is None:
        found = None
    else:
        known = small(tokens.select("n", "token").distinct())
        met = cut(places.join(known, ["n", "token"]))
        often = met.groupBy("n", "token").agg(F.count("*").alias("df"))
        ranked = tokens.join(often, ["n", "token"], "left").groupBy("wid", "length", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "token")).alias("first"), F.min(F.coalesce("df", F.lit(0))).alias("least"))
        prefix = cut(ranked.where("least > 0").select("wid", "length", "n", F.col("first.token").alias("token"), F.col("first.offset").alias("offset")))
        start = met.join(small(prefix), ["n", "token"]).select("of", "wid", (F.col("at") - F.col("offset")).alias("start"), "length", "n_words")
        start = start.where("start >= 0 and start + length <= n_words")
        spans = start.join(small(windows.select("wid", F.col("words").alias("window"), "items")), "wid")
        # Two windows with one hash of words stay two spans; the words decide below.
        found = spans.select("of", F.struct("start", "window", "items").alias("span")).distinct()
        found = found.groupBy("of").agg(F.collect_list("span").alias("spans"))
    if found is None:
        judged = docs.withColumn("spans", F.expr("cast(null as array<struct<start:int,window:array<string>,items:array<string>>>)"))
    else:
        # Another form of the key, so that both sides are dealt anew and a text with very many copies can be split.
        keyed = docs.withColumn("k", F.bitwise_not("of"))
        judged = keyed.join(found.select(F.bitwise_not("of").alias("k"), "spans"), "k", "left")
    judged = judged.select("row", "text", words_of(F.col("text")).alias("words"), "spans")
    held = judged.select("row", "text", F.size("words").alias("n_words"), F.expr("filter(coalesce(spans, array()), s -> slice(words, s.start + 1, size(s.window)) = s.window)").alias("spans"))
    held = held.withColumn("spans", F.expr("array_sort(transform(spans, s -> named_struct('start', s.start, 'stop', s.start + size(s.window), 'items', s.items)))"))
    hit = "aggregate(spans, named_struct('n', 0L, 'upto', 0), (z, s) -> named_struct('n', z.n + greatest(0, s.stop - greatest(s.start, z.upto)), 'upto', greatest(z.upto, s.stop)), z -> z.n)"
    out = held.select("row", "text", F.col("n_words").cast("long").alias("n_words"), F.expr(hit).alias("n_hit"), F.expr("array_sort(array_distinct(flatten(transform(spans, s -> s.items))))").alias("items"))
    return out.select(*((F.col("text") if c == text else F.col("row")[c]).alias(c) for c in kept), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
