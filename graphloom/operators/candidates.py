"""Stage-1 concept sources and scoring features, as DataFrame builders kept in registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first three letters of the months, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Entity labels and their concepts.
ENTITY_CONCEPTS = {"PER": "person", "ORG": "organization", "LOC": "country", "MISC": "thing"}
#: The date expressions that may start at a token, over tab-joined tokens. Months are capitalised or in lower case.
WRITTEN = "January|February|March|April|May|June|July|August|September|October|November|December|(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)[.]?"
MONTH = f"({WRITTEN}|{WRITTEN.lower()})"
DATES = {
    "six_digit": r"([0-9][0-9])([0-9][0-9])([0-9][0-9])",
    "day_month_year": rf"([0-9]?[0-9])\t{MONTH}\t([0-9][0-9][0-9][0-9])",
    "month_year": rf"{MONTH}\t([0-9][0-9][0-9][0-9])",
    "month_day_year": rf"{MONTH}\t?([0-9][0-9]?)\t?,?\t([0-9][0-9][0-9][0-9])",
    "eight_digit": r"([0-9]?[0-9][0-9]?[0-9])\t?[.-]?\t?([0-9][0-9])\t?[.-]?\t?([0-9][0-9])",
    "year": r"([0-9][0-9][0-9][0-9])",
    "month": f"{MONTH}",
}


def entity_fragment(label: Column, words: Column, wiki: bool = False) -> Column:
    """``(person :name (name :op "John" :op "Smith"))``; quotes inside words are dropped, unknown labels give null."""
    concept = F.create_map(*[F.lit(x) for kv in ENTITY_CONCEPTS.items() for x in kv])[label]
    ops = F.array_join(F.transform(words, lambda w: F.concat(F.lit(':op "'), F.replace(w, F.lit('"')), F.lit('"'))), " ")
    return F.concat(F.lit("("), concept, F.lit(" :wiki - :name (name " if wiki else " :name (name "), ops, F.lit("))"))


def month_number(month: Column) -> Column:
    """The number of a month that is written out or in digits, as text without a leading zero."""
    numbers = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, str(k))])
    return F.when(month.rlike("^[0-9]+$"), month.try_cast("int").cast("string")).otherwise(F.coalesce(F.try_element_at(numbers, F.lower(F.substring(month, 1, 3))), month))


def date_fragment(year: Column | None, month: Column | None, day: Column | None) -> Column:
    """A date fragment of the parts given: day and month as numbers, the year as it is written."""
    parts = [(" :day ", None if day is None else day.try_cast("int").cast("string")), (" :month ", None if month is None else month_number(month)), (" :year ", year)]
    return F.concat(F.lit("(date-entity"), *(x for name, value in parts if value is not None for x in (F.lit(name), value)), F.lit(")"))


def date_candidates(df: DataFrame, id: str, tail: str) -> DataFrame:
    """(id, rule, n_words, frag, feature) for every date rule that fires on the tab-joined tokens ``tail``; rules overlap on purpose.

    ``feature`` is datex1 to datex4 by the parts of the date: day, month and year; month and year; month; year.
    """
    t = F.col(tail)
    whole = {r: f"^({x})(?:\t.*)?$" for r, x in DATES.items()}
    g = lambda rule, k: F.regexp_extract(t, whole[rule], k + 1)
    six = [g("six_digit", k) for k in (1, 2, 3)]
    year = F.when(six[0].try_cast("int") < 40, F.concat(F.lit("20"), six[0])).otherwise(F.concat(F.lit("19"), six[0]))
    no_day, no_month = six[2] == "00", six[1] == "00"
    full = lambda y, m, d: (date_fragment(y, m, d), F.lit("datex1"))
    rules = {
        "six_digit": (
            F.when(no_day & no_month, date_fragment(year, None, None)).when(no_day, date_fragment(year, six[1], None)).otherwise(date_fragment(year, six[1], six[2])),
            F.when(no_day & no_month, "datex4").when(no_day, "datex2").otherwise("datex1"),
        ),
        "day_month_year": full(g("day_month_year", 3), g("day_month_year", 2), g("day_month_year", 1)),
        "month_year": (date_fragment(g("month_year", 2), g("month_year", 1), None), F.lit("datex2")),
        "month_day_year": full(g("month_day_year", 3), g("month_day_year", 1), g("month_day_year", 2)),
        "eight_digit": full(g("eight_digit", 1), g("eight_digit", 2), g("eight_digit", 3)),
        "year": (date_fragment(g("year", 1), None, None), F.lit("datex4")),
        "month": (date_fragment(None, g("month", 1), None), F.lit("datex3")),
    }
    words = lambda r: F.size(F.split(g(r, 0), "\t"))
    found = F.array(*(F.when(t.rlike(whole[r]), F.struct(F.lit(r).alias("rule"), words(r).alias("n_words"), frag.alias("frag"), feature.alias("feature"))) for r, (frag, feature) in rules.items()))
    return df.select(F.col(id), F.inline(F.filter(found, lambda x: x.isNotNull())))


#: Stage-1 features: a function of a candidate ``c`` gives (condition, name, value) triples. More can be registered.
STAGE1: dict = {}


def stage1_feature(name: str):
    return lambda f: STAGE1.setdefault(name, f)


class Candidate:
    """Columns of a candidate ``c`` (a struct of start, words, frag and, if a feature asks for them, phrase_n and indices)
    inside its sentence's row, which has sent_words and pos."""

    def __init__(self, c: Column):
        self.given = c
        self.start, self.words, self.frag, self.sent_words = c["start"], c["words"], c["frag"], F.col("sent_words")
        self.size = F.size(self.words)
        self.stop = self.start + self.size
        self.phrase = F.array_join(self.words, "_")
        self.tags = F.array_join(F.slice("pos", self.start + 1, self.size), "_")
        self.pair = F.concat(F.lit("CP="), self.phrase, F.lit("=>"), F.replace(self.frag, F.lit(" "), F.lit("_")))

    @property
    def phrase_n(self) -> Column:
        return self.given["phrase_n"]

    @property
    def indices(self) -> Column:
        return self.given["indices"]


@stage1_feature("bias")
def _bias(c):
    return [(F.lit(True), F.lit("bias"), F.lit(1.0))]


@stage1_feature("length")
def _length(c):
    return [(F.lit(True), F.lit("len"), c.size.cast("double"))]


@stage1_feature("firstMatch")
def _first_match(c):
    """The phrase stands nowhere earlier in the sentence."""
    head = F.get(c.words, F.lit(0))
    starts = F.filter(F.transform("sent_words", lambda w, i: F.when((i < c.start) & (w == head), i)), lambda i: i.isNotNull())
    earlier = F.exists(starts, lambda i: F.slice("sent_words", i + 1, c.size) == c.words)
    earlier = F.when(c.size == 1, F.array_position("sent_words", head) != c.start + 1).otherwise(earlier)
    return [(~earlier, F.lit("firstMatch"), F.lit(1.0))]


@stage1_feature("numberIndicator")
def _number(c):
    return [((c.size == 1) & c.phrase.rlike("^[0-9]*$") & (c.phrase == c.frag), F.lit("numIndicator"), F.lit(1.0))]


@stage1_feature("badConcept")
def _bad_concept(c):
    return [(c.frag.rlike("^[A-Za-z]*$") & (F.length(c.frag) <= 2), F.lit("badConcept"), F.lit(1.0))]


@stage1_feature("sentenceMatch")
def _sentence(c):
    return [(c.size == F.size("sent_words"), F.lit("sentenceMatch"), F.lit(1.0))]


@stage1_feature("andList")
def _and_list(c):
    """The first ``;`` of a sentence that is a list, and the others."""
    listed = (F.get("sent_words", c.start) == ";") & F.array_join("sent_words", " ").rlike("^[^;]+(?: ; .*)+[^.!?]$")
    first = (F.array_position("sent_words", ";") == c.start + 1) & (c.size == 1)
    return [(listed & first, F.lit("andList"), F.lit(1.0)), (listed & ~first, F.lit("andListNot"), F.lit(1.0))]


@stage1_feature("pos")
def _pos(c):
    return [(F.lit(True), F.concat(F.lit("POS="), c.tags), F.lit(1.0))]


@stage1_feature("posEvent")
def _pos_event(c):
    return [(F.lit(True), F.concat(F.lit("POS="), c.tags, F.lit("+EVENT="), F.when(c.frag.rlike("^.*-[0-9][0-9]$"), "T").otherwise("F")), F.lit(1.0))]


@stage1_feature("phrase")
def _phrase(c):
    return [(c.phrase_n > 10, F.concat(F.lit("phrase="), c.phrase), F.lit(1.0))]


@stage1_feature("phraseConceptPair")
def _pair(c):
    return [(F.size(c.indices) > 10, c.pair, F.lit(1.0))]


@stage1_feature("phraseConceptPairPOS")
def _pair_pos(c):
    name = F.concat(F.lit("CP="), c.phrase, F.lit("+POS="), c.tags, F.lit("=>"), F.replace(c.frag, F.lit(" "), F.lit("_")))
    return [(F.size(c.indices) > 3, name, F.lit(1.0))]


@stage1_feature("pairWith2WordContext")
def _pair_context(c):
    around = lambda name, i: F.concat(c.pair, F.lit(f"+{name}="), F.get("sent_words", i))
    return [(c.start > 0, around("W-1", c.start - 1), F.lit(1.0)), (c.stop < F.size("sent_words"), around("W+1", c.stop), F.lit(1.0))]


def feature_list(c: Column, names) -> Column:
    """The named features of a candidate as an array of (feature, value)."""
    unknown = sorted(set(names) - set(STAGE1))
    if unknown:
        raise ValueError(f"unknown stage-1 features: {unknown}")
    own = Candidate(c)
    none = F.array().cast("array<struct<feature:string,value:double>>")
    made = F.array(*(F.when(cond, F.struct(name.alias("feature"), value.alias("value"))) for n in names for cond, name, value in STAGE1[n](own)))
    return F.filter(made, lambda x: x.isNotNull()) if names else none


def sentence_features(sentences: DataFrame, names) -> DataFrame:
    """(sent_id, start, phrase, frag, feature, value) for the named features, from rows of whole sentences.

    A row has sent_id, sent_words, pos and candidates (see ``Candidate``). Features are built inside the row and only
    they leave it, so no candidate carries a copy of its sentence.
    """
    named = lambda c: F.transform(feature_list(c, names), lambda f: F.struct(c["start"].alias("start"), F.array_join(c["words"], " ").alias("phrase"), c["frag"].alias("frag"), f["feature"].alias("feature"), f["value"].alias("value")))
    return sentences.select("sent_id", F.inline(F.flatten(F.transform("candidates", named))))
