"""Corpus tools, sinks and scores over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import algebra, alignment, corpus, evaluation, learning
from graphloom.plans import inputs as I
from graphloom.plans import stage2

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


@query("SELECT p_partkey, '# ::id ' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '' ELSE chr(10) || '# ::tok ' || p_name END || chr(10) || '(p / part)' AS block FROM part")
def corpus_annotated(spark, sf):
    p = I.read(spark, sf, "part")
    blocks = p.select("p_partkey", F.concat(F.lit("# ::id "), F.col("p_partkey").cast("string"), F.lit("\n(p / part)")).alias("block"))
    return corpus.annotate(blocks, p.where("p_size % 3 <> 0").select("p_partkey", F.col("p_name").alias("tok")), "p_partkey")


@query("SELECT o_orderkey, CASE year(o_orderdate) WHEN 1995 THEN 'dev' WHEN 1996 THEN 'test' ELSE 'train' END AS split FROM orders")
def corpus_splits(spark, sf):
    o = I.read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return corpus.split_by_year(o, F.year("o_orderdate"), 1995, 1996).select("o_orderkey", "split")


@query("""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN 'brackets' WHEN 2 THEN 'empty brackets' WHEN 3 THEN 'relation without value' WHEN 4 THEN 'variable without concept'
WHEN 5 THEN 'slash without spaces' ELSE 'quotes' END AS problems FROM part""")
def format_check(spark, sf):
    texts = ['(p / part :name "a (b")', "(p / part :mod (b / big)", "(p / part :mod ())", "(p / part :mod )", "(p / :mod x)", "(p/part :mod x)", '(p / part :name "a)']
    p = I.read(spark, sf, "part")
    text = F.get(F.array(*map(F.lit, texts)), (F.col("p_size") % 7).cast("int"))
    return p.select("p_partkey", F.array_join(corpus.format_problems(text), ",").alias("problems"))


@query("SELECT l_orderkey AS sent_id, string_agg(l_linenumber || '-' || (l_linenumber + 1) || ' ' || w || ' => ' || lower(l_returnflag), chr(10) ORDER BY lower(w), l_linenumber, w, lower(l_returnflag)) AS listing FROM (SELECT *, CASE l_linestatus WHEN 'O' THEN 'Open' ELSE 'filled' END || (l_partkey % 9) AS w FROM lineitem) GROUP BY l_orderkey")
def span_listing(spark, sf):
    li = I.read(spark, sf, "lineitem")
    words = F.concat(F.when(F.col("l_linestatus") == "O", "Open").otherwise("filled"), (F.col("l_partkey") % 9).cast("string"))
    s = li.select(F.col("l_orderkey").alias("sent_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("stop"), words.alias("words"), F.lower("l_returnflag").alias("frag"))
    return corpus.listed_spans(s)


@query(stage2.SENTENCES + " SELECT a.raw || '_' || b.raw AS gram, count(*) AS n FROM tk a JOIN tk b ON a.sent_id = b.sent_id AND b.i = a.i + 1 GROUP BY ALL")
def tag_bigrams(spark, sf):
    return corpus.tag_counts(stage2.order_sentences(spark, sf).select("sent_id", "pos"), 2)


@query("WITH a AS (SELECT DISTINCT l_orderkey // 2 AS pair_id, l_orderkey % 2 AS side, l_suppkey AS x, l_partkey % 50 AS y, lower(l_returnflag) AS n FROM lineitem) SELECT a.pair_id, a.x AS a1, b.x AS b1, a.y AS a2, b.y AS b2, count(*) AS weight FROM a JOIN a b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.n = b.n GROUP BY ALL")
def smatch_relations(spark, sf):
    """Pairs of node pairs of neighbouring orders whose relations have the same name."""
    li = I.read(spark, sf, "lineitem")
    r = li.select(F.floor(F.col("l_orderkey") / 2).alias("pair_id"), F.col("l_returnflag").alias("name"), F.col("l_suppkey").alias("node"), (F.col("l_partkey") % 50).alias("to"), (F.col("l_orderkey") % 2).alias("m")).distinct()
    return evaluation.relation_pool(r.where("m = 0"), r.where("m = 1"))


@query("WITH a AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey) FILTER (l_linenumber % 2 = 0) AS t, list(DISTINCT l_suppkey) FILTER (l_linenumber % 3 = 0) AS g FROM lineitem GROUP BY l_orderkey), c AS (SELECT sum(len(list_intersect(coalesce(t, []), coalesce(g, [])))) AS m, sum(len(coalesce(t, []))) AS t, sum(len(coalesce(g, []))) AS g FROM a) SELECT CAST(m AS BIGINT) AS matched, CAST(t AS BIGINT) AS test, CAST(g AS BIGINT) AS gold, m / t AS precision, m / g AS recall, 2 * (m / t) * (m / g) / (m / t + m / g) AS f1 FROM c")
def alignment_scores(spark, sf):
    li = I.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey"))).alias("t"), F.collect_set(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey"))).alias("g"))
    return evaluation.alignment_scores(li, F.col("t"), F.col("g"))


@query("SELECT a.u AS user_a, round(avg(CASE WHEN b.u = 'B' THEN a.q + b.q END), 2) AS B, round(avg(CASE WHEN b.u = 'C' THEN a.q + b.q END), 2) AS C FROM (SELECT l_orderkey AS o, l_returnflag AS u, avg(l_tax) AS q FROM lineitem GROUP BY ALL) a JOIN (SELECT l_orderkey AS o, CASE l_linestatus WHEN 'O' THEN 'B' ELSE 'C' END AS u, avg(l_discount) AS q FROM lineitem GROUP BY ALL) b USING (o) GROUP BY a.u")
def agreement(spark, sf):
    li = I.read(spark, sf, "lineitem")
    a = li.groupBy("l_orderkey", F.col("l_returnflag").alias("user_a")).agg(F.avg("l_tax").alias("x"))
    b = li.groupBy("l_orderkey", F.when(F.col("l_linestatus") == "O", "B").otherwise("C").alias("user_b")).agg(F.avg("l_discount").alias("y"))
    return evaluation.agreement_table(a.join(b, "l_orderkey").select("user_a", "user_b", (F.col("x") + F.col("y")).alias("f")), ["B", "C"])


@query("SELECT feature || CASE WHEN label IS NULL THEN '' ELSE '+L=' || label END AS name, value FROM (" + "SELECT 'p' || (l_partkey % 500) AS feature, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS label, round(sum(l_tax), 6) AS value FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL) WHERE value <> 0")
def weights_written(spark, sf):
    """Weights as they are written: named with their label, without zeros."""
    w = algebra.nonzero_sorted(I.vectors(spark, sf, "a"))
    return w.select(F.concat("feature", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("+L="), "label"))).alias("name"), "value")


@query("SELECT p_brand, string_agg('f' || p_partkey || '=' || p_size || '.0', ' ' ORDER BY 'f' || p_partkey || '=' || p_size || '.0') AS line, count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS total FROM part GROUP BY p_brand")
def one_line_vectors(spark, sf):
    """Vectors as ``k=v k=v`` and read back from it."""
    p = I.read(spark, sf, "part").select("p_brand", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature"), F.col("p_size").cast("double").alias("value"))
    lines = algebra.one_line(p, "p_brand")
    back = algebra.from_one_line(F.col("line"))
    return lines.select("p_brand", "line", F.size(back).cast("long").alias("n"), F.aggregate(F.map_values(back), F.lit(0.0), lambda z, x: z + x).alias("total"))


@query("WITH g AS (SELECT l_returnflag AS feature, sum(l_tax) AS a, sum(l_discount) AS b FROM lineitem GROUP BY l_returnflag) SELECT feature, CAST(NULL AS VARCHAR) AS label, round(3 * (b - a), 4) + 0 AS value FROM g")
def perceptron_passes(spark, sf):
    """Three passes of w += gold - decoded with a decoder that does not look at the weights."""
    li = I.read(spark, sf, "lineitem")
    of = lambda c: li.groupBy(F.col("l_returnflag").alias("feature")).agg(F.sum(c).alias("value")).withColumn("label", F.lit(None).cast("string")).select("feature", "label", "value")
    w = learning.learn(lambda w, cost: of("l_tax"), of("l_discount"), learning.Options(passes=3, step=1.0))
    return w.withColumn("value", F.round("value", 4) + 0.0)


BARE = "regexp_extract({}, '^\"?(.+?)-?[0-9]*\"?$', 1)"


@query(stage2.SENTENCES + f" SELECT nd.sent_id, nd.id AS node_id, min(tk.i) AS idx FROM nd JOIN tk ON tk.sent_id = nd.sent_id AND {BARE.format('tk.concept')} = {BARE.format('nd.concept')} GROUP BY ALL")
def exact_words(spark, sf):
    """For each node the first word with its bare concept; sense and number of the words are cut as well."""
    s = stage2.order_sentences(spark, sf)
    n = s.select("sent_id", F.inline("nodes")).select("sent_id", F.col("id").alias("node_id"), "concept")
    w = s.select("sent_id", F.posexplode(F.transform("nodes", lambda n: n["concept"])).alias("idx", "c")).select("sent_id", F.col("idx").cast("long").alias("idx"), alignment.bare_concept(F.col("c")).alias("word"))
    return alignment.exact_matches(n, w)


#: Sentences, graphs and spans by rule (fixed values: documented examples of what each rule aligns); {} is a number of the row's own.
TEMPLATES = [
    ("17 July 2003", "(d / date-entity :day 17 :month 7 :year 2003)", "0-3|0+0.0+0.1+0.2"), ("021114", "(d / date-entity :year 2002 :month 11 :day 14)", "0-1|0+0.0+0.1+0.2"),
    ("U.S. troops", '(t / troop :poss (c / country :name (n / name :op1 "United" :op2 "States")))', "0-1|0.0+0.0.0+0.0.0.0+0.0.0.1 1-2|0"),
    ("the UN", '(o / organization :name (n / name :op1 "United" :op2 "Nations"))', "1-2|0+0.0+0.0.0+0.0.1"),
    ("a U N vote", '(v / vote-01 :ARG0 (o / organization :name (n / name :op1 "United" :op2 "Nations")))', "1-3|0.0+0.0.0+0.0.0.0+0.0.0.1 3-4|0"),
    ("he did not win", "(w / win-01 :polarity - :ARG0 (h / he))", "0-1|0.1 2-3|0.0 3-4|0"), ("unhappy", "(h / happy :polarity -)", "0-1|0+0.0"),
    ("the tallest tree", "(t / tree :mod (a / tall :degree (m / most)))", "1-2|0.0+0.0.0 2-3|0"), ("five miles", "(d / distance-quantity :quant 5 :unit (m / mile))", "0-1|0.0 1-2|0+0.1"),
    ("teachers", "(p / person :ARG0-of (t / teach-01))", "0-1|0+0.0"), ("president", "(p / person :ARG0-of (h / have-org-role-91 :ARG2 (q / president)))", "0-1|0+0.0+0.0.0"),
    ("governments", "(g / government-organization :ARG0-of (x / govern-01))", "0-1|0+0.0"), ("Customer {} paid", '(p / pay-01 :ARG0 (c / company :name (n / name :op1 "Customer" :op2 "{}")))', "0-2|0.0+0.0.0+0.0.0.0+0.0.0.1 2-3|0"),
]


@query("SELECT c_custkey AS sent_id, [" + ", ".join("'" + " ".join(sorted(x.split())) + "'" for _, _, x in TEMPLATES) + f"][c_custkey % {len(TEMPLATES)} + 1] AS spans FROM customer")
def aligned_by_rule(spark, sf):
    """The aligner on a sentence and graph for each customer, of the kind that a rule is for; one kind has the customer's own number."""
    pick = lambda k: F.replace(F.get(F.array(*(F.lit(t[k]) for t in TEMPLATES)), (F.col("c_custkey") % len(TEMPLATES)).cast("int")), F.lit("{}"), (F.col("c_custkey") + 100_000).cast("string"))
    df = I.read(spark, sf, "customer").select(F.col("c_custkey").alias("sent_id"), F.split(pick(0), " ").alias("words"), pick(1).alias("penman"))
    lines = alignment.alignment_lines(alignment.align_sentences(df, {"miles": ["mile"], "troops": ["troop"], "paid": ["pay"]}))
    return lines.select("sent_id", F.array_join(F.array_sort(F.split("alignments", " ")), " ").alias("spans"))


@query("WITH g AS (SELECT 'p' || (l_partkey % 50) AS feature, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS label, count(*) * 0.25::DOUBLE AS g FROM lineitem GROUP BY ALL), w AS (SELECT 'p' || (p_partkey % 70) AS feature, NULL AS label, CAST(count(*) AS DOUBLE) AS w FROM part GROUP BY ALL) SELECT coalesce(g.feature, w.feature) AS feature, CASE WHEN g.feature IS NOT NULL THEN g.label ELSE w.label END AS label, round(CASE coalesce(g.feature, w.feature) WHEN 'p1' THEN 1.0 ELSE 0.75 END * coalesce(w, 0) - 0.5 * coalesce(g, 0), 6) + 0 AS value FROM g FULL JOIN w ON g.feature = w.feature AND g.label IS NOT DISTINCT FROM w.label WHERE CASE coalesce(g.feature, w.feature) WHEN 'p1' THEN 1.0 ELSE 0.75 END * coalesce(w, 0) - 0.5 * coalesce(g, 0) <> 0")
def scaled_step(spark, sf):
    """One step of descent with L2 as a factor; the feature p1 is not regularized."""
    li = I.read(spark, sf, "lineitem")
    g = li.groupBy(F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("feature"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("label")).agg((F.count("*") * 0.25).alias("value"))
    w = I.read(spark, sf, "part").groupBy(F.concat(F.lit("p"), (F.col("p_partkey") % 70).cast("string")).alias("feature")).agg((F.count("*") / 4.0).alias("value")).select("feature", F.lit(None).cast("string").alias("label"), "value")
    moved, scale = algebra.scaled_sgd(w, 4.0, g, 0.5, 0.5, ("p1",))
    return moved.select("feature", "label", F.round(F.col("value") * scale, 6).alias("value")).where("value <> 0")


@query("SELECT count(*) AS n, min(k) AS first, max(k) AS last, count(DISTINCT k) AS places FROM (SELECT row_number() OVER () - 1 AS k FROM orders)")
def shuffled_orders(spark, sf):
    """Places of all orders in a random order: each from 0 on once."""
    o = corpus.shuffled(I.read(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey"), 3)
    return o.agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))
