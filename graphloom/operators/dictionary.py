"""Phrase-to-fragment dictionaries: counting, derived features, matching, merging (W3 and its use)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_op_numbers(fragment: Column) -> Column:
    return F.regexp_replace(fragment, ":op[0-9]*", ":op")


def phrase_concept_counts(pairs: DataFrame, cap: int = 10_000) -> DataFrame:
    """(phrase, frag, n, indices): occurrences and the distinct sentences they are in; over ``cap`` of those none are kept.

    The sentences of a pair are counted before any are gathered, so no list passes ``cap``. Where ``pairs`` has the fragment's
    ``concepts``, ``held`` has their different arrays with how often each occurs (concepts, n).
    """
    with_concepts = "concepts" in pairs.columns
    if with_concepts:
        # All that follows looks at these counts, and no join has to leave out nulls below them, so that pairs are made and dealt
        # out once.
        each = pairs.where("phrase is not null and frag is not null").repartition("phrase", "frag", "sent").groupBy("phrase", "frag", "sent", "concepts").agg(F.count("*").alias("n"))
        once = each.groupBy("phrase", "frag", "sent").agg(F.sum("n").alias("k"))
    else:
        once = pairs.groupBy("phrase", "frag", "sent").agg(F.count("*").alias("k"))
    totals = once.groupBy("phrase", "frag").agg(F.sum("k").alias("n"), F.count("*").alias("m"))
    # Both look at ``k``, so that they share what is counted by sentence.
    few = once.where("k > 0").join(totals.where(F.col("m") <= cap).select("phrase", "frag"), ["phrase", "frag"], "left_semi").groupBy("phrase", "frag").agg(F.sort_array(F.collect_list("sent")).alias("indices"))
    none = F.array().cast(few.schema["indices"].dataType)
    out = totals.join(few, ["phrase", "frag"], "left").select("phrase", "frag", "n", F.coalesce("indices", none).alias("indices"))
    if not with_concepts:
        return out
    held = each.groupBy("phrase", "frag", "concepts").agg(F.sum("n").alias("n"))
    return out.join(held.groupBy("phrase", "frag").agg(F.collect_list(F.struct("concepts", "n")).alias("held")), ["phrase", "frag"], "left")


def fragment_counts(pairs: DataFrame, n: Column | None = None) -> DataFrame:
    """(frag, n): rows of each fragment, or what ``n`` gives over them."""
    return pairs.groupBy("frag").agg((F.count("*") if n is None else n).alias("n"))


def concept_counts(concepts: DataFrame, n: Column | None = None) -> DataFrame:
    """(concept, n, total, log_pr): each concept's count (its rows, or what ``n`` gives over them) and ln of its share."""
    by = concepts.groupBy("concept").agg((F.count("*") if n is None else n).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("concept", "n", "total", F.ln(F.col("n") / F.col("total")).alias("log_pr"))  # one row


def phrase_counts(table: DataFrame, occurrences: DataFrame, inflated: bool = True) -> DataFrame:
    """(phrase, n): how often a phrase occurs; ``inflated`` counts once for each table entry that matches."""
    entries = table.groupBy("phrase").agg(F.count("*").alias("k"))
    seen = occurrences.groupBy("phrase").agg(F.count("*").alias("m"))
    n = F.col("m") * F.col("k") if inflated else F.col("m")
    return seen.join(entries, "phrase").select("phrase", n.alias("n"))


def derived_features(counts: DataFrame, fragments: DataFrame, phrases: DataFrame) -> DataFrame:
    """A dictionary's features of each phrase and fragment: corpus (1), corpus_len (words of the phrase), count (n), and
    the logs of the shares of the fragment among the phrase's and of the phrase among the fragment's occurrences."""
    f, p = fragments.withColumnRenamed("n", "frag_n"), phrases.withColumnRenamed("n", "phrase_n")
    joined = counts.join(f, "frag").join(p, "phrase")
    return joined.select(
        "phrase", "frag", "n", F.lit(1.0).alias("corpus"), F.col("n").cast("double").alias("count"),
        F.ln(F.col("n") / F.col("phrase_n")).alias("c_given_p"),
        F.ln(F.col("n") / F.col("frag_n")).alias("p_given_c"),
        F.size(F.split("phrase", " ")).alias("corpus_len"),
    )


def fragment_log_probability(fragments: DataFrame, concepts: DataFrame) -> DataFrame:
    """(frag, log_pr): the logs of the shares of a fragment's concepts among all concepts, added up.

    ``fragments`` has frag and concepts (array, repeats included); ``concepts`` is what ``concept_counts`` gives.
    """
    long = fragments.select("frag", F.explode("concepts").alias("concept"))
    return long.join(concepts.select("concept", "log_pr"), "concept").groupBy("frag").agg(F.sum("log_pr").alias("log_pr"))


def leave_one_out(entries: DataFrame, sentence: Column, distance: int = 20) -> DataFrame:
    """Entries that some sentence more than ``distance`` away has taught."""
    return entries.where(F.exists("indices", lambda j: F.abs(j - sentence) > distance))


#: Values that a dictionary may hold in all to be sent to the places of phrases, which else are dealt out by phrase.
HELD = 1_000_000


def extent(table: DataFrame) -> tuple[list[int], int]:
    """The lengths of the phrases of ``table``, which are a few numbers, and how many values its rows hold."""
    held = sum((F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)) for c, kind in table.dtypes if kind.startswith(("array", "map"))), F.lit(1))
    told = table.agg(F.sort_array(F.collect_set(F.size("words"))).alias("sizes"), F.sum(held).alias("held")).first()
    return told["sizes"], told["held"] or 0


def match_dictionary(sentences: DataFrame, table: DataFrame) -> DataFrame:
    """(sent_id, start, phrase, and ``table``'s columns but words): table entries whose words stand in a sentence.

    ``sentences`` has sent_id and words, ``table`` words. The join is on an entry's words as one string, so that a
    frequent first word is no hot key; a sentence's places give a string for each length that entries have.
    """
    rest = [c for c in table.columns if c != "words"]
    sizes, held = extent(table)
    if not sizes:
        return sentences.where("false").select("sent_id", F.lit(0).alias("start"), F.lit("").alias("phrase"), *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in rest))

    def runs_of(n: int) -> Column:
        phrase = lambda i: F.array_join(F.slice(F.col("words"), i + 1, n), " ")
        return F.transform("words", lambda w, i: F.when(i + n <= F.size("words"), F.struct(i.cast("int").alias("start"), phrase(i).alias("phrase"))))

    runs = [runs_of(n) for n in sizes]
    places = sentences.select("sent_id", F.inline(F.filter(F.concat(*runs), lambda r: r.isNotNull())))
    entries = table.select(F.array_join("words", " ").alias("phrase"), *rest)
    # Spark cannot tell the size of given rows, and few phrases of many places would be few parts of a join.
    entries = F.broadcast(entries) if held <= HELD else entries
    return places.join(entries, "phrase").select("sent_id", "start", "phrase", *rest)


def merge_candidates(candidates: DataFrame, keys=("sent_id", "start", "phrase", "frag")) -> DataFrame:
    """One row for each of ``keys``: features added up, training indices (if there) put together.

    A candidate without features stays, with an empty map.
    """
    add = lambda z, x: F.map_zip_with(z, x, lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    features = F.aggregate(F.collect_list("features"), F.create_map().cast("map<string,double>"), add)
    more = [F.sort_array(F.flatten(F.collect_list("indices"))).alias("indices")] if "indices" in candidates.columns else []
    return candidates.groupBy(*keys).agg(features.alias("features"), *more)


def word_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("tok").agg(F.count("*").alias("n"))


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def first_occurrence(matches: DataFrame) -> DataFrame:
    """Matches with ``first``: whether the phrase stands nowhere earlier in its sentence."""
    w = Window.partitionBy("sent_id", "phrase")
    return matches.withColumn("first", F.col("start") == F.min("start").over(w))
