"""Stems of words by part of speech: irregular forms, endings that are taken off, and a lexicon that knows the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings and what stands for them, by part of speech.
ENDINGS = {
    "noun": [("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "verb": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "adj": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "adv": [],
}


def regular(word: Column) -> Column:
    """(pos, stem) of the word itself and of the word with each fitting ending replaced, for each part of speech."""
    form = lambda pos, stem, cond: F.when(cond, F.struct(F.lit(pos).alias("pos"), stem.alias("stem")))
    own = [form(pos, word, F.lit(True)) for pos in ENDINGS]
    cut = [form(pos, F.concat(F.left(word, F.length(word) - len(old)), F.lit(new)), word.endswith(old) & (F.length(word) > len(old))) for pos, rules in ENDINGS.items() for old, new in rules]
    return F.array_distinct(F.filter(F.array(*own, *cut), lambda x: x.isNotNull()))


def stems(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(surface, pos, stem) of each distinct ``surface`` of ``words``, as ``Knowledge.stems`` takes it.

    ``lexicon`` (stem, pos) knows the words that there are; ``exceptions`` (surface, pos, stem) irregular forms. A word's
    irregular stems for a part of speech stand in place of regular ones; the word itself is a stem if the lexicon has it.
    Words are compared lower-cased. Only distinct words are joined.
    """
    own = words.select("surface").where("surface is not null").distinct().withColumn("low", F.lower("surface"))
    made = own.select("surface", "low", F.inline(regular(F.col("low"))))
    known = lexicon.select(F.lower("stem").alias("stem"), "pos").distinct()
    found = made.join(known, ["stem", "pos"], "left_semi")
    if exceptions is not None:
        odd = exceptions.select(F.lower("surface").alias("low"), "pos", F.lower("stem").alias("irregular"))
        found = found.where("stem = low").unionByName(found.where("stem <> low").join(odd.select("low", "pos").distinct(), ["low", "pos"], "left_anti"))
        found = found.unionByName(own.join(odd, "low").select("surface", "low", "pos", F.col("irregular").alias("stem")))
    return found.select("surface", "pos", "stem").distinct()
