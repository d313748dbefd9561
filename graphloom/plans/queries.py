"""Named queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import algebra, candidates, decoding, dictionary, evaluation, graphs, parsing
from graphloom.plans import inputs as I
from graphloom.sources import text as reader

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = I.sql(oracle, *views)
        return f

    return add


# Readers ---------------------------------------------------------------------------------------


@query("SELECT sent_id, idx, tok FROM tok", "sent", "tok")
def tokens(spark, sf):
    return I.tokens(spark, sf)


@query("SELECT tok, count(*) AS n FROM tok GROUP BY tok", "sent", "tok")
def word_freq(spark, sf):
    return dictionary.word_frequencies(I.tokens(spark, sf))


TALK = "talk AS (SELECT conv_id, string_agg('(' || role || ' ' || turn || chr(10) || text, chr(10) || chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"


def talk(spark, sf):
    """Conversations as block files: turns with blank lines between."""
    c = I.read(spark, sf, "conversations")
    line = F.concat(F.lit("("), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), "\n\n\n").alias("t"))


@query(TALK + r", b AS (SELECT conv_id, [x for x in regexp_split_to_array(t, '\n\n+') if x <> ''] AS bs FROM talk) SELECT conv_id, CAST(unnest(range(len(bs))) AS INTEGER) AS block_no, unnest(bs) AS block FROM b")
def blocks(spark, sf):
    return reader.graph_blocks(reader.blocks(talk(spark, sf), "conv_id", "t"))


ORACLE["blocks"] = "WITH " + ORACLE["blocks"]


@query("SELECT conv_id, turn, 'c' || conv_id AS id, role AS who, coalesce(nullif(regexp_extract(text, '^[^ ]+', 0), ''), '') AS first FROM conversations")
def metadata(spark, sf):
    c = I.read(spark, sf, "conversations")
    line = F.concat(F.lit("# ::id c"), F.col("conv_id").cast("string"), F.lit(" ::annotator "), "role", F.lit(" ::first "), F.regexp_extract("text", "^[^ ]+", 0))
    m = reader.metadata(line)
    return c.select("conv_id", "turn", m["::id"].alias("id"), m["::annotator"].alias("who"), m["::first"].alias("first"))


@query("SELECT l_orderkey, l_linenumber, '(o / order)' AS graph, 'line ' || l_linenumber AS tok, l_linenumber || '-' || (l_linenumber + 1) || '|0' AS alignment, CAST(2 AS INTEGER) AS n_alignments FROM lineitem")
def training_records(spark, sf):
    li = I.read(spark, sf, "lineitem")
    n = F.col("l_linenumber").cast("string")
    block = F.concat(F.lit("# ::tok line "), n, F.lit("\n# ::alignments 0-1|0 ::annotator a\n# ::alignments "), n, F.lit("-"), (F.col("l_linenumber") + 1).cast("string"), F.lit("|0 ::annotator b\n(o / order)"))
    r = reader.record(block)
    return li.select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.graph", "r.tok", "r.alignment", F.size("r.alignments").alias("n_alignments"))


CONLL = "d AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_name FROM nation)"


def conll(spark, sf):
    n = I.read(spark, sf, "nation")
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    line = F.concat_ws("\t", F.col("k").cast("string"), "n_name", F.lit("_"), F.lit("NN"), F.lit("NNP"), F.lit("_"), (F.col("k") - 1).cast("string"), F.when(F.col("k") == 1, "root").otherwise("nn"))
    return n.withColumn("k", k).groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("x")))), lambda s: s["x"]), "\n").alias("block"))


@query("WITH " + CONLL + " SELECT n_regionkey, CAST(k - 1 AS INTEGER) AS idx, n_name AS form, 'NNP' AS pos, CAST(k - 2 AS INTEGER) AS head, CASE WHEN k = 1 THEN 'root' ELSE 'nn' END AS rel FROM d")
def dependencies(spark, sf):
    return reader.dependencies(conll(spark, sf), "n_regionkey", "block")


@query("SELECT p_partkey, 'nn' AS rel, CAST(p_size - 1 AS INTEGER) AS head, CAST(p_size AS INTEGER) AS dependent FROM part")
def typed_dependencies(spark, sf):
    p = I.read(spark, sf, "part")
    t = reader.typed_dependency(F.concat(F.lit("nn("), F.split("p_name", " ")[0], F.lit("-"), F.col("p_size").cast("string"), F.lit(", "), F.split("p_name", " ")[1], F.lit("-"), (F.col("p_size") + 1).cast("string"), F.lit(")")))
    return p.select("p_partkey", t.alias("t")).select("p_partkey", "t.rel", "t.head", "t.dependent")


RUNS = """tagged AS (SELECT *, CASE WHEN tok = 'view' THEN 'O' ELSE tok END AS lab FROM ev),
m AS (SELECT *, CASE WHEN lab <> 'O' AND lab IS DISTINCT FROM lag(lab) OVER (PARTITION BY sent_id ORDER BY idx) THEN 1 ELSE 0 END AS s FROM tagged),
g AS (SELECT *, sum(s) OVER (PARTITION BY sent_id ORDER BY idx) AS run FROM m)
SELECT sent_id, min(idx) AS start, max(idx) + 1 AS stop, upper(lab) AS label FROM g WHERE lab <> 'O' GROUP BY sent_id, run, lab"""


@query(RUNS, "ev")
def entity_runs(spark, sf):
    e = I.events(spark, sf)
    before = F.lag("tok").over(Window.partitionBy("sent_id").orderBy("idx"))
    tag = F.when(F.col("tok") == "view", "O").otherwise(F.concat(F.when(before == F.col("tok"), "I-").otherwise("B-"), F.upper("tok")))
    return reader.entities(e.withColumn("tag", tag), "sent_id", "idx", "tag")


@query(RUNS, "ev")
def bilou_runs(spark, sf):
    e, w = I.events(spark, sf), Window.partitionBy("sent_id").orderBy("idx")
    same = F.coalesce(F.lag("tok").over(w) == F.col("tok"), F.lit(False))
    more = F.coalesce(F.lead("tok").over(w) == F.col("tok"), F.lit(False))
    kind = F.when(same & more, "I-").when(same, "L-").when(more, "B-").otherwise("U-")
    tag = F.when(F.col("tok") == "view", "O").otherwise(F.concat(kind, F.upper("tok")))
    return reader.entities(e.withColumn("tag", tag), "sent_id", "idx", "tag")


@query("""SELECT c_custkey, k AS place, CASE k WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' ELSE 'O' END AS tag,
CASE k WHEN 0 THEN string_split(c_name, '#')[1] WHEN 1 THEN string_split(c_name, '#')[2] WHEN 2 THEN 'bought' ELSE lower(c_mktsegment) END AS token FROM customer, range(4) r(k)""")
def bracket_tags(spark, sf):
    c = I.read(spark, sf, "customer")
    said = F.concat(F.lit("[PER "), F.split("c_name", "#")[0], F.lit(" "), F.split("c_name", "#")[1], F.lit("] bought "), F.lower("c_mktsegment"))
    return c.select("c_custkey", F.posexplode(reader.bracket_tags(said)).alias("place", "t")).select("c_custkey", F.col("place").cast("long").alias("place"), "t.tag", "t.token")


@query("SELECT s_suppkey, s_nationkey AS pred_start, s_nationkey + 1 AS pred_stop, a AS arg, CASE a WHEN 'A0' THEN 0 ELSE s_nationkey + 2 END AS arg_start, CASE a WHEN 'A0' THEN s_nationkey ELSE s_nationkey + 4 END AS arg_stop FROM supplier, (VALUES ('A0'), ('AM-TMP')) v(a)")
def predicate_arguments(spark, sf):
    k = F.col("s_nationkey")
    c = lambda x: x.cast("string")
    line = F.concat(F.lit("V:"), c(k), F.lit("-"), c(k + 1), F.lit(" A0:0-"), c(k), F.lit(" AM-TMP:"), c(k + 2), F.lit("-"), c(k + 4))
    return reader.predicate_arguments(I.read(spark, sf, "supplier").select("s_suppkey", line.alias("line")), "s_suppkey", "line")


@query("SELECT p_partkey, string_split(p_name, ' ')[2] AS second, '(thing :mod ' || p_type || ')' AS frag, round(CAST(p_size AS DOUBLE), 6) AS n, CAST(CASE WHEN p_size > 25 THEN 2 ELSE 0 END AS INTEGER) AS n_indices FROM part")
def concept_rows(spark, sf):
    size = F.col("p_size").cast("string")
    line = F.concat("p_name", F.lit(" ||| (thing :mod "), "p_type", F.lit(") ||| Count="), size, F.lit(" N=1.0"), F.when(F.col("p_size") > 25, F.concat(F.lit(" ||| 1 "), size)).otherwise(""))
    r = reader.concept_row(line)
    return I.read(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.col("r.words")[1].alias("second"), "r.frag", F.col("r.features")["Count"].alias("n"), F.size("r.training_indices").alias("n_indices"))


@query("SELECT p_partkey, p_name AS phrase, p_size AS n FROM part")
def phrase_count_rows(spark, sf):
    r = reader.phrase_count(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")))
    return I.read(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.array_join("r.words", " ").alias("phrase"), "r.n")


@query("SELECT p_partkey, 'f=' || replace(p_name, ' ', '_') AS feature, CASE WHEN p_size % 2 = 0 THEN ':' || lower(p_type) END AS label, CAST(p_size AS DOUBLE) AS value FROM part")
def weight_rows(spark, sf):
    line = F.concat(F.lit("f="), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("+L=:"), F.lower("p_type"))).otherwise(""), F.when(F.col("p_size") % 3 == 0, "\t").otherwise(" "), F.col("p_size").cast("string"))
    r = reader.weight(line)
    return I.read(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.feature", "r.label", "r.value")


@query("SELECT p_partkey, ':' || lower(p_type) AS label, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1000 END AS max_card FROM part")
def label_limits(spark, sf):
    r = reader.label_limit(F.concat(F.lit(":"), F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("")))
    return I.read(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.label", "r.max_card")


@query("SELECT o_orderkey, o_orderstatus AS status, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def zipped_layers(spark, sf):
    o = I.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    li = I.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return reader.zip_layers({"snt": o.join(li, "o_orderkey", "left_semi"), "dep": li}, "o_orderkey")


@query("SELECT c_custkey, '(' || c_name || ')/' AS t, '# ::snt ' || c_name || '  x' AS line, c_name || ' x' AS snt FROM customer")
def unescaped(spark, sf):
    c = I.read(spark, sf, "customer")
    line = F.concat(F.lit("# ::snt "), "c_name", F.lit("  x"))
    return c.select("c_custkey", reader.unescape_brackets(F.concat(F.lit("-LRB-"), "c_name", F.lit("-RRB-\\/"))).alias("t"), reader.unfold(reader.fold(line)).alias("line"), reader.sentence_of(line).alias("snt"))


# Dictionaries ----------------------------------------------------------------------------------


@query("SELECT phrase, frag, count(*) AS n, CASE WHEN count(DISTINCT sent) <= 10000 THEN count(DISTINCT sent) ELSE 0 END AS n_indices FROM pairs GROUP BY phrase, frag", "pairs")
def phrase_concept_counts(spark, sf):
    return dictionary.phrase_concept_counts(I.pairs(spark, sf)).select("phrase", "frag", "n", F.size("indices").cast("long").alias("n_indices"))


@query("SELECT frag, count(*) AS n FROM pairs GROUP BY frag", "pairs")
def fragment_counts(spark, sf):
    return dictionary.fragment_counts(I.pairs(spark, sf))


@query("SELECT p_type AS concept, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, round(ln(count(*) / sum(count(*)) OVER ()), 6) AS log_pr FROM part GROUP BY p_type")
def log_pr_concept(spark, sf):
    c = dictionary.concept_counts(I.read(spark, sf, "part").select(F.col("p_type").alias("concept")))
    return c.withColumn("log_pr", F.round("log_pr", 6))


K = "k AS (SELECT phrase, count(DISTINCT frag) AS k, count(*) AS m FROM pairs GROUP BY phrase)"


@query(K + " SELECT phrase, k * m AS n FROM k", "pairs")
def phrase_counts(spark, sf):
    p = I.pairs(spark, sf)
    return dictionary.phrase_counts(p.select("phrase", "frag").distinct(), p)


@query(K + """, c AS (SELECT phrase, frag, count(*) AS n FROM pairs GROUP BY ALL), f AS (SELECT frag, count(*) AS fn FROM pairs GROUP BY frag)
SELECT phrase, frag, n, round(ln(n / (k * m)), 6) AS c_given_p, round(ln(n / fn), 6) AS p_given_c, CAST(2 AS INTEGER) AS corpus_len, 1.0::DOUBLE AS corpus, CAST(n AS DOUBLE) AS count FROM c JOIN f USING (frag) JOIN k USING (phrase)""", "pairs")
def dictionary_features(spark, sf):
    p = I.pairs(spark, sf)
    counts = dictionary.phrase_concept_counts(p)
    d = dictionary.derived_features(counts, dictionary.fragment_counts(p), dictionary.phrase_counts(counts, p))
    return d.withColumn("c_given_p", F.round("c_given_p", 6)).withColumn("p_given_c", F.round("p_given_c", 6))


@query("SELECT phrase, frag FROM pairs GROUP BY ALL HAVING max(abs(sent - 100)) > 20 AND count(DISTINCT sent) <= 10000", "pairs")
def leave_one_out(spark, sf):
    return dictionary.leave_one_out(dictionary.phrase_concept_counts(I.pairs(spark, sf)), F.lit(100)).select("phrase", "frag")


@query("n AS (SELECT sent_id, idx AS start, tok || ' ' || lead(tok) OVER (PARTITION BY sent_id ORDER BY idx) AS phrase FROM tok) SELECT sent_id, start, phrase, frag FROM n JOIN (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:2], ' ') AS phrase, string_split(text, ' ')[1] AS frag FROM benchmark WHERE len(string_split(text, ' ')) > 1) USING (phrase)", "sent", "tok")
def dictionary_match(spark, sf):
    b = I.read(spark, sf, "benchmark").select(F.split("text", " ").alias("w")).where("size(w) > 1")
    return dictionary.match_dictionary(I.sentences(spark, sf), b.select(F.slice("w", 1, 2).alias("words"), F.col("w")[0].alias("frag")).distinct())


@query("SELECT conv_id, turn, gram, count(*) AS n FROM (SELECT conv_id, turn, unnest([array_to_string(ws[i:i + 1], ' ') for i in range(1, len(ws))]) AS gram FROM (SELECT conv_id, turn, [w for w in regexp_split_to_array(text, '[ \\n]') if w <> ''] AS ws FROM conversations)) GROUP BY ALL")
def ngram_phrases(spark, sf):
    c = I.read(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split("text", "[ \n]"), lambda w: w != "").alias("ws"))
    return c.select("conv_id", "turn", F.explode(dictionary.ngrams(F.col("ws"), 2)).alias("gram")).groupBy("conv_id", "turn", "gram").agg(F.count("*").alias("n"))


@query("SELECT sent_id, idx, tok, idx = min(idx) OVER (PARTITION BY sent_id, tok) AS first FROM tok", "sent", "tok")
def first_match(spark, sf):
    t = I.tokens(spark, sf).withColumnRenamed("tok", "phrase").withColumnRenamed("idx", "start")
    return dictionary.first_occurrence(t).select("sent_id", F.col("start").alias("idx"), F.col("phrase").alias("tok"), "first")


@query("SELECT CAST(l_orderkey AS BIGINT) AS sent_id, l_returnflag AS frag, round(sum(l_tax), 6) AS tax, count(*) AS n FROM lineitem GROUP BY ALL")
def merged_candidates(spark, sf):
    li = I.read(spark, sf, "lineitem")
    c = li.select(F.col("l_orderkey").alias("sent_id"), F.lit(0).alias("start"), F.lit("x").alias("phrase"), F.col("l_returnflag").alias("frag"), F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("n"), F.lit(1.0)).alias("features"))
    m = dictionary.merge_candidates(c)
    return m.select("sent_id", "frag", F.round(F.col("features")["tax"], 6).alias("tax"), F.col("features")["n"].cast("long").alias("n"))


# Candidates and stage-1 features -----------------------------------------------------------------


def token_places(spark, sf):
    return I.tokens(spark, sf).select("sent_id", F.col("idx").alias("start"), F.col("tok").alias("word"), F.lit(None).cast("string").alias("tag"))


def event_places(spark, sf):
    return I.events(spark, sf).select("sent_id", F.col("idx").alias("start"), F.col("tok").alias("word"), F.when(F.col("idx") % 2 == 0, "VBZ").otherwise("NN").alias("tag"))


@query("SELECT sent_id, idx AS start, tok AS phrase, tok AS frag FROM tok WHERE regexp_full_match(tok, '[A-Za-z0-9]*')", "sent", "tok")
def passthrough(spark, sf):
    return parsing.from_source("PassThrough", token_places(spark, sf))


@query("""c AS (SELECT c_custkey AS sent_id, string_split(replace(c_name, '#', ' ') || ' of ' || lower(c_mktsegment) || ' !', ' ') AS words FROM customer)
SELECT sent_id, CAST(i AS INTEGER) AS start, array_to_string(words[i + 1:i + j], ' ') AS phrase, '(thing :name (name ' || array_to_string([':op ' || w for w in words[i + 1:i + j]], ' ') || '))' AS frag
FROM c, range(5) a(i), range(1, 7) b(j) WHERE i < len(words) AND i + j < len(words) AND len([w for w in words[i + 1:i + j] if NOT regexp_full_match(w, '[A-Za-z0-9.-]*')]) = 0""")
def ne_passthrough(spark, sf):
    c = I.read(spark, sf, "customer")
    words = F.split(F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" of "), F.lower("c_mktsegment"), F.lit(" !")), " ")
    return parsing.from_source("NEPassThrough", parsing.places_of(c.select(F.col("c_custkey").alias("sent_id"), words.alias("words"), F.array().cast("array<string>").alias("pos"))))


ORACLE["ne_passthrough"] = "WITH " + ORACLE["ne_passthrough"]


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'person' WHEN c_custkey % 4 = 1 THEN 'organization' WHEN c_custkey % 4 = 2 THEN 'country' ELSE 'thing' END AS c, '(' || CASE WHEN c_custkey % 4 = 0 THEN 'person' WHEN c_custkey % 4 = 1 THEN 'organization' WHEN c_custkey % 4 = 2 THEN 'country' ELSE 'thing' END || ' :name (name :op \"' || replace(c_name, '#', '\" :op \"') || '\"))' AS frag FROM customer")
def ner_candidates(spark, sf):
    c = I.read(spark, sf, "customer")
    label = F.element_at(F.array(*map(F.lit, ("PER", "ORG", "LOC", "MISC"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    frag = candidates.entity_fragment(label, F.split("c_name", "#"))
    return c.select("c_custkey", F.regexp_extract(frag, r"^\(([a-z]+)", 1).alias("c"), frag.alias("frag"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate AS t, o_orderkey % 6 AS k FROM orders),
y AS (SELECT *, '(date-entity :day ' || day(t) || ' :month ' || month(t) || ' :year ' AS dmy, strftime(t, '%Y') AS yr FROM d)
SELECT o_orderkey, 'day_month_year' AS rule, 3 AS n_words, dmy || yr || ')' AS frag, 'datex1' AS feature FROM y WHERE k = 0
UNION ALL SELECT o_orderkey, 'month_day_year', CASE k WHEN 1 THEN 4 ELSE 3 END, dmy || yr || ')', 'datex1' FROM y WHERE k IN (1, 4)
UNION ALL SELECT o_orderkey, 'month', 1, '(date-entity :month ' || month(t) || ')', 'datex3' FROM y WHERE k IN (1, 4)
UNION ALL SELECT o_orderkey, 'eight_digit', 1, dmy || yr || ')', 'datex1' FROM y WHERE k IN (2, 5)
UNION ALL SELECT o_orderkey, 'six_digit', 1, dmy || CASE WHEN yr[3:4] < '40' THEN '20' ELSE '19' END || yr[3:4] || ')', 'datex1' FROM y WHERE k = 3
UNION ALL SELECT o_orderkey, 'eight_digit', 1, dmy || yr[3:4] || ')', 'datex1' FROM y WHERE k = 3""")
def date_candidates(spark, sf):
    """Orders' dates in six ways of writing; six digits are also read as a year of two digits, month and day."""
    o = I.read(spark, sf, "orders")
    t, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 6
    spaced = lambda form: F.replace(F.date_format(t, form), F.lit(" "), F.lit("\t"))
    tail = F.when(k == 0, spaced("d MMMM yyyy")).when(k == 1, spaced("MMMM d , yyyy")).when(k == 2, F.date_format(t, "yyyy-MM-dd"))
    tail = tail.when(k == 3, F.date_format(t, "yyMMdd")).when(k == 4, F.lower(spaced("MMMM d yyyy"))).otherwise(F.date_format(t, "yyyy.MM.dd"))
    return candidates.date_candidates(o.select("o_orderkey", tail.alias("tail")), "o_orderkey", "tail")


STEMS = "(VALUES ('view','view'),('viewed','view'),('click','click'),('purchase','purchase'),('purchase','buy'))"


def stems(spark):
    return spark.createDataFrame([("view", "view"), ("viewed", "view"), ("click", "click"), ("purchase", "purchase"), ("purchase", "buy")], "surface string, stem string")


@query(f"SELECT sent_id, idx AS start, tok AS phrase, stem || '-01' AS frag FROM ev JOIN {STEMS} s(surface, stem) ON tok = surface WHERE stem IN ('view', 'buy')", "ev")
def predicate_candidates(spark, sf):
    listed = spark.createDataFrame([("view-01",), ("buy-01",)], "predicate string")
    return parsing.from_source("OntoNotes", event_places(spark, sf), parsing.Knowledge(stems=stems(spark), predicates=listed))


@query(f"SELECT sent_id, idx AS start, tok AS phrase, coalesce(stem, tok) || '-00' AS frag FROM ev LEFT JOIN (SELECT surface, arg_min(stem, (length(stem), stem)) AS stem FROM {STEMS} s(surface, stem) GROUP BY surface) ON tok = surface WHERE idx % 2 = 0", "ev")
def verb_candidates(spark, sf):
    return parsing.from_source("verbs", event_places(spark, sf), parsing.Knowledge(stems=stems(spark)))


@query("SELECT sent_id, idx AS start, tok AS phrase, CASE tok WHEN 'purchase' THEN 'buy' ELSE tok END AS frag FROM ev WHERE tok IN ('view', 'click', 'purchase')", "ev")
def stem_candidates(spark, sf):
    return parsing.from_source("WordNetPassThrough", event_places(spark, sf), parsing.Knowledge(stems=stems(spark)))


@query("SELECT sent_id, idx AS start, tok AS phrase, tok AS frag FROM ev WHERE false", "ev")
def nominalizations(spark, sf):
    return parsing.from_source("nominalizations", event_places(spark, sf))


STAGE1 = ("bias", "length", "numberIndicator", "badConcept", "sentenceMatch", "andList", "pos", "posEvent", "pairWith2WordContext", "firstMatch")


def stage1_input(spark, sf):
    """Conversation turns as sentences; every word is a candidate for itself."""
    c = I.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sent_id"), F.split("text", "[ \n]+").alias("sent_words"))
    c = c.withColumn("pos", F.transform("sent_words", lambda w: F.when(w.rlike("^[A-Z]"), "NNP").otherwise("NN")))
    return c.withColumn("candidates", F.transform("sent_words", lambda w, i: F.struct(i.alias("start"), F.array(w).alias("words"), w.alias("frag"))))


@query("""WITH c AS (SELECT conv_id * 100 + turn AS sent_id, row_number() OVER () AS r, regexp_split_to_array(text, '[ \\n]+') AS ws FROM conversations),
t AS (SELECT r, ws, regexp_full_match(array_to_string(ws, ' '), '[^;]+(?: ; .*)+[^.!?]') AS listed, list_position(ws, ';') AS sm, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM c),
p AS (SELECT *, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'NNP' ELSE 'NN' END AS pos, min(i) OVER (PARTITION BY r, w) AS f, 'CP=' || w || '=>' || replace(w, ' ', '_') AS cp FROM t),
a AS (SELECT 'bias' AS feature FROM p UNION ALL SELECT 'len' FROM p
UNION ALL SELECT 'numIndicator' FROM p WHERE regexp_full_match(w, '[0-9]*') UNION ALL SELECT 'badConcept' FROM p WHERE regexp_full_match(w, '[A-Za-z]*') AND length(w) <= 2
UNION ALL SELECT 'sentenceMatch' FROM p WHERE len(ws) = 1 UNION ALL SELECT 'POS=' || pos FROM p UNION ALL SELECT 'POS=' || pos || '+EVENT=' || CASE WHEN regexp_matches(w, '-[0-9][0-9]$') THEN 'T' ELSE 'F' END FROM p
UNION ALL SELECT CASE WHEN i + 1 = sm THEN 'andList' ELSE 'andListNot' END FROM p WHERE w = ';' AND listed
UNION ALL SELECT cp || '+W-1=' || ws[i] FROM p WHERE i > 0 UNION ALL SELECT cp || '+W+1=' || ws[i + 2] FROM p WHERE i + 1 < len(ws) UNION ALL SELECT 'firstMatch' FROM p WHERE i = f)
SELECT feature, count(*) AS n, CAST(count(*) AS DOUBLE) AS value FROM a GROUP BY feature""")
def stage1_features(spark, sf):
    f = candidates.sentence_features(stage1_input(spark, sf), STAGE1)
    return f.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


# Stage-1 decoding --------------------------------------------------------------------------------

CELLS = "cells AS (SELECT sent_id, start, stop, frag, score FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, stop ORDER BY score DESC, start DESC, frag) AS k FROM cand WHERE score >= 0) WHERE k = 1)"


@query(CELLS + " SELECT * FROM cells", "ev", "cand")
def chart_cells(spark, sf):
    return decoding.chart(I.span_candidates(spark, sf)).select("sent_id", "start", "stop", "frag", "score")


@query(CELLS + ", arr AS (SELECT sent_id, list(struct_pack(stop := stop, start := start, frag := frag, score := score) ORDER BY stop DESC) AS l FROM cells GROUP BY sent_id), walk AS (SELECT sent_id, l, 1 AS i, l[1].start AS edge, true AS kept FROM arr UNION ALL SELECT sent_id, l, i + 1, CASE WHEN l[i + 1].stop <= edge THEN l[i + 1].start ELSE edge END, l[i + 1].stop <= edge FROM walk WHERE i < len(l)) SELECT sent_id, l[i].start AS start, l[i].stop AS stop, l[i].frag AS frag, l[i].score AS score FROM walk WHERE kept", "ev", "cand")
def chart_decode(spark, sf):
    return decoding.best_spans(I.span_candidates(spark, sf))


GOLD = "gold AS (SELECT sent_id, idx AS start, idx + 1 AS stop, tok AS frag FROM ev WHERE idx % 2 = 0)"


def gold_spans(spark, sf):
    return I.events(spark, sf).where("idx % 2 = 0").select("sent_id", F.col("idx").alias("start"), (F.col("idx") + 1).alias("stop"), F.col("tok").alias("frag"))


@query(GOLD + " SELECT cand.* FROM cand SEMI JOIN gold USING (sent_id, start, stop, frag)", "ev", "cand")
def stage1_oracle(spark, sf):
    return decoding.oracle_candidates(I.span_candidates(spark, sf), gold_spans(spark, sf)).select("sent_id", "start", "stop", "frag", "score")


COSTS = ", j AS (SELECT cand.*, gold.frag AS g FROM cand LEFT JOIN gold USING (sent_id, start, stop)), w AS (SELECT *, max(CASE WHEN g = frag THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id, start, stop) AS ok FROM j)"


@query(GOLD + COSTS + " SELECT sent_id, start, stop, frag, CASE WHEN g = frag THEN -0.75::DOUBLE WHEN g IS NULL THEN 0.25::DOUBLE WHEN ok = 1 THEN 0.25::DOUBLE ELSE -0.75::DOUBLE END AS cost FROM w", "ev", "cand")
def span_cost(spark, sf):
    return decoding.span_cost(I.span_candidates(spark, sf), gold_spans(spark, sf), 0.25).select("sent_id", "start", "stop", "frag", "cost")


@query(GOLD + COSTS + " SELECT sent_id, start, stop, frag, CASE WHEN g = frag THEN -0.75::DOUBLE ELSE 0.25::DOUBLE END AS cost FROM w", "ev", "cand")
def span_cost_simple(spark, sf):
    return decoding.span_cost(I.span_candidates(spark, sf), gold_spans(spark, sf), 0.25, kind=2).select("sent_id", "start", "stop", "frag", "cost")


@query("SELECT c_custkey, '(entity :op \"' || c_name || '\"))' AS frag FROM customer")
def normal_entity(spark, sf):
    c = I.read(spark, sf, "customer")
    return c.select("c_custkey", decoding.normal_entity(candidates.entity_fragment(F.lit("PER"), F.array("c_name"))).alias("frag"))


# The cover's cells are one or two words long here. Of a run of stops with cells of two words, every other one from the
# right is kept; a cell of one word goes if the cell that stops after it has two words and is kept.
@query("""c AS (SELECT sent_id, idx AS start, idx + 1 AS stop, tok AS frag, CAST(0.15 AS DOUBLE) AS score FROM tok WHERE regexp_full_match(tok, '[A-Za-z0-9]*')
  UNION ALL SELECT sent_id, idx, idx + 2, frag, CAST(0.5 AS DOUBLE) FROM (SELECT sent_id, idx, tok || ' ' || lead(tok) OVER (PARTITION BY sent_id ORDER BY idx) AS phrase FROM tok)
  JOIN (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:2], ' ') AS phrase, '(phrase :mod ' || string_split(text, ' ')[2] || ')' AS frag FROM benchmark WHERE len(string_split(text, ' ')) > 1) USING (phrase)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, stop ORDER BY score DESC, start DESC, frag) AS k FROM c) WHERE k = 1),
two AS (SELECT *, stop - row_number() OVER (PARTITION BY sent_id ORDER BY stop) AS run FROM k WHERE stop - start = 2),
kept AS (SELECT sent_id, start, stop, frag, score FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, run ORDER BY stop DESC) AS back FROM two) WHERE back % 2 = 1)
SELECT * FROM kept UNION ALL SELECT k.sent_id, k.start, k.stop, k.frag, k.score FROM k ANTI JOIN kept b ON b.sent_id = k.sent_id AND b.stop = k.stop + 1 WHERE k.stop - k.start = 1""", "sent", "tok")
def parse_cover(spark, sf):
    """Flagship: documents to words, words and the phrases of a dictionary as candidates, scored by weights, and the cover of each document."""
    s = I.sentences(spark, sf)
    b = I.read(spark, sf, "benchmark").select(F.split("text", " ").alias("w")).where("size(w) > 1")
    frag = F.concat(F.lit("(phrase :mod "), F.col("w")[1], F.lit(")"))
    entries = b.select(F.slice("w", 1, 2).alias("words"), frag.alias("frag")).distinct()
    phrases = dictionary.match_dictionary(s, entries).select("sent_id", "start", (F.col("start") + 2).alias("stop"), "frag", F.lit(0.5).alias("score"))
    words = parsing.from_source("PassThrough", token_places(spark, sf)).select("sent_id", "start", (F.col("start") + 1).alias("stop"), "frag", F.lit(0.15).alias("score"))
    return decoding.best_spans(words.unionByName(phrases))


# Graphs --------------------------------------------------------------------------------------------

GORN = "o AS (SELECT *, row_number() OVER (PARTITION BY sent_id, src ORDER BY ord, dst) - 1 AS i FROM te), ids AS (SELECT sent_id, node_id AS node, '0' AS gorn FROM tn WHERE node_id LIKE 'r%' UNION ALL SELECT o.sent_id, o.dst, gorn || '.' || i FROM ids JOIN o ON o.sent_id = ids.sent_id AND o.src = ids.node)"


def gorn(spark, sf):
    roots = I.tree_nodes(spark, sf).where("node_id like 'r%'").select("sent_id", F.col("node_id").alias("node"))
    return graphs.gorn_ids(roots, I.tree_edges(spark, sf))


@query(GORN + " SELECT * FROM ids", "tn", "te")
def gorn_ids(spark, sf):
    return gorn(spark, sf)


@query(GORN + " SELECT sent_id, node, gorn, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY [CAST(x AS INTEGER) for x in string_split(gorn, '.')]) AS INTEGER) AS place FROM ids", "tn", "te")
def preorder(spark, sf):
    return graphs.preorder(gorn(spark, sf))


@query("SELECT sent_id, '# ::node' || chr(9) || node_id || chr(9) || concept || chr(9) || CASE WHEN concept = 'building' THEN '' ELSE length(node_id) || '-' || (length(node_id) + 1) END AS line FROM tn", "tn")
def nodes_sink(spark, sf):
    """Nodes of one kind have no span."""
    n = I.tree_nodes(spark, sf)
    at = lambda k: F.when(F.col("concept") != "building", (F.length("node_id") + k).cast("string"))
    return graphs.node_rows(n.withColumn("start", at(0)).withColumn("stop", at(1)))


@query("SELECT sent_id, '# ::root' || chr(9) || node_id || chr(9) || concept AS line FROM tn WHERE node_id LIKE 'r%'", "tn")
def root_sink(spark, sf):
    return graphs.root_rows(I.tree_nodes(spark, sf).where("node_id like 'r%'"))


JOINED = "j AS (SELECT te.*, a.concept AS sc, b.concept AS dc FROM te JOIN tn a ON te.sent_id = a.sent_id AND src = a.node_id JOIN tn b ON te.sent_id = b.sent_id AND dst = b.node_id)"


@query(JOINED + " SELECT sent_id, '# ::edge' || chr(9) || sc || chr(9) || substr(label, 2) || chr(9) || dc || chr(9) || src || chr(9) || dst || chr(9) AS line FROM j", "tn", "te")
def edges_sink(spark, sf):
    return graphs.edge_rows(I.tree_edges(spark, sf), I.tree_nodes(spark, sf))


def with_variables(spark, sf):
    """Nodes with a variable, their id, but for those of one kind."""
    return I.tree_nodes(spark, sf).withColumn("var", F.when(F.col("concept") != "building", F.col("node_id")))


NAMED = JOINED + ", q AS (SELECT sent_id, ord, substr(label, 2) AS rel, sc, dc, CASE WHEN sc = 'building' THEN sc ELSE src || ' / ' || sc END AS a, CASE WHEN dc = 'building' THEN dc ELSE dst || ' / ' || dc END AS b FROM j), t AS (SELECT *, {} AS line FROM q) SELECT sent_id, string_agg(line, chr(10) ORDER BY line) AS triples FROM t GROUP BY sent_id"


def triples_query(detail: int, line: str):
    def run(spark, sf):
        return graphs.triples(with_variables(spark, sf), I.tree_edges(spark, sf), detail)

    run.__name__ = f"tree_triples_{detail}"
    return query(NAMED.format(line), "tn", "te")(run)


for detail, line in enumerate(("'(' || sc || ', ' || rel || ', ' || dc || ')'", "'(' || a || ', ' || rel || ', ' || b || ')'", "rel || '(' || sc || ', ' || dc || ')'", "rel || '(' || a || ', ' || b || ')'", "'(' || a || ', ' || b || ', ' || rel || ')'")):
    triples_query(detail, line)


@query(JOINED + ", k AS (SELECT sent_id, src, string_agg(chr(10) || '  ' || label || ' ' || CASE WHEN dc = 'building' THEN dc ELSE dst END, '' ORDER BY ord, label, CASE WHEN dc = 'building' THEN dc ELSE dst END) AS below FROM j GROUP BY sent_id, src) SELECT tn.sent_id, node_id, '(' || node_id || ' / ' || concept || coalesce(below, '') || ')' AS stanza FROM tn LEFT JOIN k ON tn.sent_id = k.sent_id AND node_id = src WHERE concept <> 'building'", "tn", "te")
def disconnected_graphs(spark, sf):
    return graphs.disconnected(with_variables(spark, sf), I.tree_edges(spark, sf))


@query(JOINED + ", k AS (SELECT sent_id, src AS node_id, string_agg(label || ' ' || dc, ' ' ORDER BY label || ' ' || dc) AS kids FROM j WHERE src LIKE 'n%' GROUP BY sent_id, src), f AS (SELECT j.sent_id, src, string_agg(label || ' (' || dc || ' ' || kids || ')', ' ' ORDER BY label || ' ' || dc) AS kids FROM j JOIN k ON j.sent_id = k.sent_id AND dst = node_id GROUP BY j.sent_id, src) SELECT tn.sent_id, tn.node_id, '(' || concept || ' ' || kids || ')' AS frag FROM tn JOIN f ON tn.sent_id = f.sent_id AND node_id = src", "tn", "te")
def canonical_fragments(spark, sf):
    n = I.tree_nodes(spark, sf)
    return graphs.canonical_fragments(n, n.where("node_id like 'r%'"), I.tree_edges(spark, sf))


@query("SELECT sent_id, CASE WHEN label LIKE '%-of' THEN dst ELSE src END AS src, regexp_replace(label, '-of$', '') AS label, CASE WHEN label LIKE '%-of' THEN src ELSE dst END AS dst FROM te", "te")
def inverse_norm(spark, sf):
    return graphs.normalize_inverse(I.tree_edges(spark, sf)).select("sent_id", "src", "label", "dst")


@query("SELECT sent_id, src, CASE label WHEN ':mod-of' THEN ':domain' ELSE label END AS label, dst FROM te", "te")
def modof_norm(spark, sf):
    return I.tree_edges(spark, sf).select("sent_id", "src", graphs.normalize_mod(F.col("label")).alias("label"), "dst")


@query("SELECT sent_id, src, label, dst FROM te UNION ALL SELECT sent_id, dst, CASE WHEN label LIKE '%-of' THEN regexp_replace(label, '-of$', '') ELSE label || '-of' END, src FROM te", "te")
def inverse_relations(spark, sf):
    return graphs.with_inverses(I.tree_edges(spark, sf))


@query("SELECT sent_id, src, CASE WHEN label = ':op' THEN ':op' || row_number() OVER (PARTITION BY sent_id, src, label ORDER BY -ord, dst) ELSE label END AS label, dst FROM te", "te")
def op_renumber(spark, sf):
    e = I.tree_edges(spark, sf)
    return graphs.number_ops(e, e.select("sent_id", "dst", (-F.col("ord")).alias("start"))).select("sent_id", "src", "label", "dst")


@query("SELECT c_custkey, '(x :op a :op b)' AS frag FROM customer")
def op_removal(spark, sf):
    k = F.col("c_custkey").cast("string")
    return I.read(spark, sf, "customer").select("c_custkey", dictionary.strip_op_numbers(F.concat(F.lit("(x :op"), k, F.lit(" a :op2 b)"))).alias("frag"))


@query("SELECT sent_id, src, label, dst, CAST(row_number() OVER (PARTITION BY sent_id, src ORDER BY label, ord) - 1 AS INTEGER) AS ord FROM te", "te")
def sorted_relations(spark, sf):
    return graphs.sort_relations(I.tree_edges(spark, sf)).select("sent_id", "src", "label", "dst", "ord")


@query("SELECT p_partkey, p_size % 3 = 0 AS constant FROM part")
def constants(spark, sf):
    c = F.when(F.col("p_size") % 9 == 0, F.lit("-")).when(F.col("p_size") % 9 == 3, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.lower("p_type"))
    return I.read(spark, sf, "part").select("p_partkey", graphs.is_constant(c).alias("constant"))


ALIGNED = "al AS (SELECT sent_id, node_id FROM tn WHERE substr(node_id, 1, 1) IN ('r', 'n') OR right(node_id, 1) < '5')"


def aligned(spark, sf):
    return I.tree_nodes(spark, sf).where("substr(node_id, 1, 1) in ('r', 'n') or right(node_id, 1) < '5'").select("sent_id", "node_id")


@query(ALIGNED + " SELECT sent_id, src, label, dst FROM te WHERE (sent_id, src) IN (SELECT (sent_id, node_id) FROM al) AND (sent_id, dst) IN (SELECT (sent_id, node_id) FROM al)", "tn", "te")
def cleared_edges(spark, sf):
    return graphs.clear_unaligned(I.tree_nodes(spark, sf), I.tree_edges(spark, sf), aligned(spark, sf))[1]


@query(ALIGNED + " SELECT tn.* FROM tn ANTI JOIN al USING (sent_id, node_id)", "tn")
def unaligned_nodes(spark, sf):
    return graphs.unaligned(I.tree_nodes(spark, sf), aligned(spark, sf)).select("sent_id", "node_id", "concept")


SPANS = "sp AS (SELECT l_orderkey AS sent_id, l_linenumber AS span_id, l_linenumber AS start, l_linenumber + 1 + CAST(l_quantity AS INTEGER) % 3 - 1 AS stop, ['p' || (l_partkey % 5), 'q' || (l_suppkey % 5)] AS node_ids, l_returnflag = 'R' AS coref FROM lineitem)"


def spans(spark, sf):
    li = I.read(spark, sf, "lineitem")
    n = lambda p, c: F.concat(F.lit(p), (F.col(c) % 5).cast("string"))
    return li.select(F.col("l_orderkey").alias("sent_id"), F.col("l_linenumber").alias("span_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("stop"), F.array(n("p", "l_partkey"), n("q", "l_suppkey")).alias("node_ids"), (F.col("l_returnflag") == "R").alias("coref"))


PRIMARY = ", u AS (SELECT sent_id, span_id, coref, unnest(node_ids) AS node_id FROM sp), pr AS (SELECT sent_id, node_id, arg_min(span_id, CAST(coref AS INTEGER) * 1000 + span_id) AS span_id FROM u GROUP BY ALL)"


@query("WITH " + SPANS + PRIMARY + " SELECT * FROM pr")
def primary_spans(spark, sf):
    return graphs.primary_spans(spans(spark, sf))


@query("WITH " + SPANS + PRIMARY + ", e AS (SELECT DISTINCT sent_id, node_ids[1] AS src, ':r' AS label, node_ids[2] AS dst FROM sp) SELECT e.* FROM e JOIN pr a ON e.sent_id = a.sent_id AND src = a.node_id JOIN pr b ON e.sent_id = b.sent_id AND dst = b.node_id WHERE a.span_id = b.span_id")
def fragment_edges(spark, sf):
    s = spans(spark, sf)
    e = s.select("sent_id", F.col("node_ids")[0].alias("src"), F.lit(":r").alias("label"), F.col("node_ids")[1].alias("dst")).distinct()
    return graphs.fragment_edges(e, graphs.primary_spans(s))


@query("WITH " + SPANS + " SELECT sent_id, idx, array_to_string(list(span_id ORDER BY span_id), ' ') AS spans FROM (SELECT sent_id, span_id, unnest(range(start, stop)) AS idx FROM sp) GROUP BY sent_id, idx")
def token_spans(spark, sf):
    return graphs.span_words(spans(spark, sf)).select("sent_id", F.col("idx").cast("long").alias("idx"), F.array_join(F.transform("spans", lambda x: x.cast("string")), " ").alias("spans"))


@query("WITH " + SPANS + " SELECT sent_id, span_id, CASE WHEN start < stop THEN CASE WHEN coref THEN '*' ELSE '' END || start || '-' || stop || '|' || array_to_string(list_sort(node_ids), '+') ELSE '' END AS span FROM sp")
def span_format(spark, sf):
    return spans(spark, sf).select("sent_id", "span_id", graphs.format_span(F.col("start"), F.col("stop"), F.col("node_ids"), F.col("coref")).alias("span"))


@query("WITH " + SPANS + ", l AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY span_id, CASE WHEN coref THEN '*' ELSE '' END || start || '-' || stop || '|' || array_to_string(list_sort(node_ids), '+')) - 1 AS k FROM sp WHERE start < stop) SELECT sent_id, CAST(k AS INTEGER) AS span_id, start, stop, array_to_string(list_sort(node_ids), '+') AS ids, coref, false AS bad FROM l UNION ALL SELECT sent_id, CAST(count(*) AS INTEGER), NULL, NULL, '', false, true FROM l GROUP BY sent_id")
def span_load(spark, sf):
    s = spans(spark, sf).where("start < stop")
    text = s.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_id", graphs.format_span(F.col("start"), F.col("stop"), F.col("node_ids"), F.col("coref")).alias("x")))), lambda z: z["x"]), " ").alias("t"))
    out = graphs.load_spans(text.withColumn("t", F.concat("t", F.lit(" 3-x|0"))), "sent_id", "t")
    return out.select("sent_id", "span_id", "start", "stop", F.array_join("node_ids", "+").alias("ids"), "coref", "bad")


@query("SELECT sent_id, CASE WHEN n = 1 THEN f ELSE f || n END AS var, node_id FROM (SELECT *, substr(concept, 1, 1) AS f, row_number() OVER (PARTITION BY sent_id, substr(concept, 1, 1) ORDER BY node_id) AS n FROM tn)", "tn")
def variables(spark, sf):
    return graphs.name_variables(I.tree_nodes(spark, sf).withColumn("ord", F.col("node_id")).withColumn("var", F.substring("concept", 1, 1))).select("sent_id", "var", "node_id")


@query("t AS (SELECT sent_id, CAST(arg_min(node_id, node_id) AS VARCHAR) AS target FROM tn WHERE node_id LIKE 'n%' GROUP BY sent_id) SELECT te.sent_id, src, label, CASE WHEN dst LIKE 'c%' AND tn.concept = 'building' THEN target ELSE dst END AS dst, dst LIKE 'c%' AND tn.concept = 'building' AS reentrant FROM te JOIN tn ON te.sent_id = tn.sent_id AND te.dst = tn.node_id JOIN t ON t.sent_id = te.sent_id", "tn", "te")
def unified_variables(spark, sf):
    n = I.tree_nodes(spark, sf)
    first = n.where("node_id like 'n%'").groupBy("sent_id").agg(F.min("node_id").alias("first"))
    n = n.join(first, "sent_id").withColumn("var", F.when(F.col("node_id") == F.col("first"), "building"))
    return graphs.unify_variables(n, I.tree_edges(spark, sf))


@query("SELECT l_orderkey AS sent_id, least('p' || l_partkey % 7, 's' || l_suppkey % 7) AS a, greatest('p' || l_partkey % 7, 's' || l_suppkey % 7) AS b, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def simple_graph(spark, sf):
    li = I.read(spark, sf, "lineitem")
    n = lambda p, c: F.concat(F.lit(p), (F.col(c) % 7).cast("string"))
    return graphs.not_simple(li.select(F.col("l_orderkey").alias("sent_id"), n("p", "l_partkey").alias("src"), n("s", "l_suppkey").alias("dst")))


LINKS = "li AS (SELECT DISTINCT l_orderkey % 50 AS sent_id, l_partkey % 200 AS a, 1000 + l_suppkey % 40 AS b FROM lineitem WHERE l_linenumber = 1)"


def links(spark, sf):
    return I.read(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") % 50).alias("sent_id"), (F.col("l_partkey") % 200).alias("src"), (1000 + F.col("l_suppkey") % 40).alias("dst")).distinct()


@query("WITH RECURSIVE " + LINKS + ", n AS (SELECT sent_id, a AS x FROM li UNION SELECT sent_id, b FROM li), r AS (SELECT sent_id, x, x AS c FROM n UNION SELECT r.sent_id, CASE WHEN r.x = li.a THEN li.b ELSE li.a END, r.c FROM r JOIN li ON li.sent_id = r.sent_id AND (r.x = li.a OR r.x = li.b)) SELECT sent_id, x AS node_id, min(c) AS component FROM r GROUP BY sent_id, x")
def components(spark, sf):
    e = links(spark, sf)
    n = e.select("sent_id", F.col("src").alias("node_id")).union(e.select("sent_id", "dst")).distinct()
    return graphs.components(n, e)


CYC = "e AS (SELECT DISTINCT l_orderkey AS sent_id, l_partkey % 4 AS src, l_suppkey % 4 AS dst FROM lineitem)"


@query("WITH RECURSIVE " + CYC + ", r AS (SELECT sent_id, src, dst FROM e UNION SELECT r.sent_id, r.src, e.dst FROM r JOIN e ON e.sent_id = r.sent_id AND e.src = r.dst) SELECT sent_id, max(CAST(src = dst AS INTEGER)) = 1 AS cyclic FROM r GROUP BY sent_id")
def cycle_check(spark, sf):
    return graphs.has_cycle(I.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sent_id"), (F.col("l_partkey") % 4).alias("src"), (F.col("l_suppkey") % 4).alias("dst")).distinct())


UP = "up AS (SELECT sent_id, node_id AS node, [node_id] AS path FROM tn WHERE node_id LIKE 'r%' UNION ALL SELECT te.sent_id, dst, list_prepend(dst, path) FROM up JOIN te ON te.sent_id = up.sent_id AND te.src = up.node)"


def root_paths(spark, sf):
    e = I.tree_edges(spark, sf).select("sent_id", F.col("dst").alias("node"), F.col("src").alias("parent"))
    roots = I.tree_nodes(spark, sf).where("node_id like 'r%'").select("sent_id", F.col("node_id").alias("node"), F.lit(None).cast("string").alias("parent"))
    return graphs.ancestors(e.unionByName(roots))


@query(UP + " SELECT sent_id, node, array_to_string(path, ' ') AS path FROM up", "tn", "te")
def root_path(spark, sf):
    return root_paths(spark, sf).select("sent_id", "node", F.array_join("path", " ").alias("path"))


@query(UP + ", z AS (SELECT sent_id, node, list_reverse(path) AS p FROM up), f AS (SELECT sent_id, min(node) AS x FROM z GROUP BY sent_id) SELECT f.sent_id, f.x, b.node AS y, CAST(len([i for i in range(1, least(len(a.p), len(b.p)) + 1) if a.p[1:i] = b.p[1:i]]) AS INTEGER) AS shared FROM f JOIN z a ON a.sent_id = f.sent_id AND a.node = f.x JOIN z b ON b.sent_id = f.sent_id AND b.node <> f.x", "tn", "te")
def lca_path_all(spark, sf):
    """The common path of every node and the least node of its tree."""
    p = root_paths(spark, sf).select("sent_id", "node", "path")
    least = p.groupBy("sent_id").agg(F.min(F.struct("node", "path")).alias("a"))
    pairs = p.join(least, "sent_id").where("node != a.node")
    return pairs.select("sent_id", F.col("a.node").alias("x"), F.col("node").alias("y"), graphs.common_suffix(F.col("a.path"), F.col("path")).alias("shared"))


@query("w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a FROM part), v AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS b FROM part) SELECT a, b, CAST(len([i for i in range(1, least(length(a), length(b)) + 1) if left(a, i) = left(b, i)]) AS INTEGER) AS lcp FROM w, v")
def prefix_match(spark, sf):
    p = I.read(spark, sf, "part").select(F.split("p_name", " ").alias("w"))
    a, b = p.select(F.col("w")[0].alias("a")).distinct(), p.select(F.col("w")[1].alias("b")).distinct()
    return a.crossJoin(b).select("a", "b", graphs.common_prefix_length(F.col("a"), F.col("b")).alias("lcp"))


ORACLE["prefix_match"] = "WITH " + ORACLE["prefix_match"]


@query("SELECT a, b, CAST(len([i for i in range(1, least(length(a), length(b)) + 1) if left(a, i) = left(b, i)]) AS INTEGER) AS lcp FROM (SELECT DISTINCT tok AS a FROM tok) JOIN (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]')) AS b FROM benchmark) ON left(a, 4) = left(b, 4) WHERE length(a) > 3 AND length(b) > 3", "sent", "tok")
def fuzzy_words(spark, sf):
    """Words of the documents and of the benchmark that begin alike."""
    words = lambda df, c: df.select(F.col("tok").alias(c)).distinct()
    bench = reader.tokens(I.read(spark, sf, "benchmark").withColumnRenamed("item_id", "sent_id"), "sent_id", "text")
    return graphs.shared_prefixes(words(I.tokens(spark, sf), "a"), words(bench, "b"))


# Edge decoding, vectors, scores ---------------------------------------------------------------------


@query("SELECT sent_id, src, dst, label, score FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, src, dst ORDER BY score DESC, label) AS k FROM sc) WHERE k = 1", "sc")
def edge_label_argmax(spark, sf):
    return decoding.best_labels(I.edge_scores(spark, sf)).select("sent_id", "src", "dst", "label", "score")


@query("SELECT sent_id, src, dst, label, score FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, src, label ORDER BY score DESC, dst) AS k FROM sc WHERE score > 0) WHERE k <= max_card", "sc")
def alg1_topk(spark, sf):
    return decoding.top_labels(I.edge_scores(spark, sf)).select("sent_id", "src", "dst", "label", "score")


@query("SELECT sent_id, node_id FROM (SELECT sent_id, node_id, row_number() OVER (PARTITION BY sent_id ORDER BY -length(concept), node_id) AS k FROM tn) WHERE k = 1", "tn")
def root_argmax(spark, sf):
    return decoding.best_root(I.tree_nodes(spark, sf).withColumn("score", F.length("concept").cast("double")))


@query("x AS (SELECT sent_id, idx, CAST(length(tok) AS DOUBLE) AS f, substr(tok, 1, 1) AS feature FROM ev), w AS (SELECT feature, ascii(feature) / 100 AS value FROM x GROUP BY feature) SELECT sent_id, round(sum(f * value), 4) AS score FROM x JOIN w USING (feature) GROUP BY sent_id", "ev")
def sparse_dot(spark, sf):
    x = I.events(spark, sf).select("sent_id", F.length("tok").cast("double").alias("f"), F.substring("tok", 1, 1).alias("feature"))
    w = x.select("feature").distinct().withColumn("value", F.ascii("feature") / 100)
    return algebra.dot(x, w, "sent_id").select("sent_id", F.round("score", 4).alias("score"))


BOTH = "SELECT feature, label, round(sum(value), 6) + 0 AS value FROM (SELECT * FROM va UNION ALL SELECT feature, label, {} * value FROM vb) GROUP BY feature, label HAVING sum(value) <> 0"


@query(BOTH.format("1"), "va", "vb")
def vector_add(spark, sf):
    return algebra.add(I.vectors(spark, sf, "a"), I.vectors(spark, sf, "b")).withColumn("value", F.round("value", 6) + 0.0)


@query(BOTH.format("-0.5"), "va", "vb")
def vector_subtract(spark, sf):
    return algebra.add(I.vectors(spark, sf, "a"), I.vectors(spark, sf, "b"), -0.5).withColumn("value", F.round("value", 6) + 0.0)


@query("SELECT va.feature, va.label, round(va.value / vb.value, 6) + 0 AS value FROM va JOIN vb ON va.feature = vb.feature AND va.label IS NOT DISTINCT FROM vb.label WHERE vb.value <> 0", "va", "vb")
def vector_divide(spark, sf):
    return algebra.divide(I.vectors(spark, sf, "a"), I.vectors(spark, sf, "b")).withColumn("value", F.round("value", 6) + 0.0)


@query("SELECT * FROM va WHERE feature IN (SELECT feature FROM vb WHERE label = 'R' AND value > 0.5)", "va", "vb")
def vector_filter(spark, sf):
    return algebra.keep(I.vectors(spark, sf, "a"), I.vectors(spark, sf, "b").where("label = 'R' and value > 0.5")).select("feature", "label", "value")


ADA = "j AS (SELECT coalesce(va.feature, vb.feature) AS feature, coalesce(va.label, vb.label) AS label, coalesce(va.value, 0) AS w, vb.value AS g FROM va FULL JOIN (SELECT * FROM vb WHERE value <> 0) vb ON va.feature = vb.feature AND va.label IS NOT DISTINCT FROM vb.label), k AS (SELECT feature, label, w, g + 0.01 * w AS g FROM j)"


@query(ADA + " SELECT feature, label, round(CASE WHEN g IS NULL OR g = 0 THEN w ELSE w - 0.5 * g / sqrt(g * g) END, 6) + 0 AS value FROM k", "va", "vb")
def adagrad_step(spark, sf):
    w, g = I.vectors(spark, sf, "a"), I.vectors(spark, sf, "b")
    return algebra.adagrad(w, w.where("false"), g, 0.5, 0.01)[0].withColumn("value", F.round("value", 6) + 0.0)


@query("SELECT feature, label, round(sum(value) * (1 - 0.1 * 0.2), 6) + 0 AS value FROM (SELECT * FROM va UNION ALL SELECT feature, label, -0.1 * value FROM vb) GROUP BY feature, label HAVING sum(value) <> 0", "va", "vb")
def sgd_step(spark, sf):
    return algebra.sgd(I.vectors(spark, sf, "a"), I.vectors(spark, sf, "b"), 0.1, 0.2).withColumn("value", F.round("value", 6) + 0.0)


@query("SELECT feature, label, round(sum(value) / 2, 6) + 0 AS value FROM (SELECT * FROM va UNION ALL SELECT * FROM vb) GROUP BY feature, label", "va", "vb")
def avg_weights(spark, sf):
    return algebra.average([I.vectors(spark, sf, "a"), I.vectors(spark, sf, "b")], True).withColumn("value", F.round("value", 6) + 0.0)


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(2 * p_size AS DOUBLE) AS b, 1.0::DOUBLE AS c FROM part")
def map_merge(spark, sf):
    s = F.col("p_size").cast("double")
    m = algebra.merge_maps(F.create_map(F.lit("a"), s, F.lit("b"), s), F.create_map(F.lit("b"), s, F.lit("c"), F.lit(1.0)))
    return I.read(spark, sf, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


PRF = "CASE WHEN t > 0 THEN m / t ELSE 0 END AS precision, CASE WHEN g > 0 THEN m / g ELSE 0 END AS recall, CASE WHEN m > 0 THEN 2 * (m / t) * (m / g) / (m / t + m / g) ELSE 0 END AS f1"


@query(GOLD + ", p AS (SELECT DISTINCT sent_id, start, stop, frag FROM cand), x AS (SELECT (SELECT count(*) FROM p JOIN gold USING (sent_id, start, stop, frag)) AS m, (SELECT count(*) FROM p) AS t, (SELECT count(*) FROM gold) AS g) SELECT m AS matched, t AS predicted, g AS gold, " + PRF + " FROM x", "ev", "cand")
def span_f1(spark, sf):
    return evaluation.span_f1(I.span_candidates(spark, sf), gold_spans(spark, sf), ["sent_id", "start", "stop", "frag"])


@query(GOLD + " SELECT * FROM gold ANTI JOIN cand USING (sent_id, start, stop, frag)", "ev", "cand")
def missing_spans(spark, sf):
    return evaluation.missing(I.span_candidates(spark, sf), gold_spans(spark, sf), ["sent_id", "start", "stop", "frag"])


@query("a AS (SELECT sent_id, list_distinct(list(tok) FILTER (idx % 2 = 0)) AS t, list_distinct(list(tok) FILTER (idx % 3 = 0)) AS g FROM ev GROUP BY sent_id) SELECT sent_id, CAST(len(list_intersect(t, g)) AS INTEGER) AS matched, CAST(len(t) AS INTEGER) AS test, CAST(len(g) AS INTEGER) AS gold FROM a", "ev")
def align_f1(spark, sf):
    e = I.events(spark, sf).groupBy("sent_id").agg(F.collect_set(F.when(F.col("idx") % 2 == 0, F.col("tok"))).alias("t"), F.collect_set(F.when(F.col("idx") % 3 == 0, F.col("tok"))).alias("g"))
    return e.select("sent_id", evaluation.alignment_counts(F.col("t"), F.col("g")).alias("c")).select("sent_id", "c.matched", "c.test", "c.gold")


@query("a AS (SELECT l_orderkey // 2 AS pair_id, l_linenumber AS node, lower(l_returnflag) AS v FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey // 2 AS pair_id, l_linenumber AS node, lower(l_returnflag) AS v FROM lineitem WHERE l_orderkey % 2 = 1) SELECT a.pair_id, a.node AS a, b.node AS b, count(*) AS weight FROM a JOIN b ON a.pair_id = b.pair_id AND a.v = b.v GROUP BY ALL")
def smatch_pool_all(spark, sf):
    """Node pairs of neighbouring orders that could match."""
    li = I.read(spark, sf, "lineitem")
    g = li.select(F.floor(F.col("l_orderkey") / 2).alias("pair_id"), F.lit("instance").alias("kind"), F.col("l_linenumber").alias("node"), F.lit("instance").alias("name"), F.col("l_returnflag").alias("value"), (F.col("l_orderkey") % 2).alias("m"))
    return evaluation.overlap_pool(g.where("m = 0"), g.where("m = 1"))


ORACLE["smatch_pool_all"] = "WITH " + ORACLE["smatch_pool_all"]
