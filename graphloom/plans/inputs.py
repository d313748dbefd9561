"""The driver's tables seen as sentences, dictionaries, graphs, spans and vectors.

Each view has a twin in DuckDB's SQL (``SQL``), so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.text import tokens as split_tokens


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sentences(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("sent_id"), F.filter(F.split("text", "[ \n]"), lambda w: w != "").alias("words"))


def tokens(spark, sf):
    return split_tokens(read(spark, sf, "documents").withColumnRenamed("doc_id", "sent_id"), "sent_id", "text")


def pairs(spark, sf):
    """Phrase and fragment of each order line: the part's name and type; the sentence is the order."""
    lines, part = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), read(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    joined = lines.join(part, lines.l_partkey == part.p_partkey)
    return joined.select(F.col("p_name").alias("phrase"), F.concat(F.lit("(thing :mod "), F.lower("p_type"), F.lit(")")).alias("frag"), F.col("l_orderkey").alias("sent"))


def by_order(df, key="l_orderkey"):
    """``df`` dealt out by order: what is told apart, grouped and joined by order first stays where it is, so that all views
    of a query share one exchange of what they read. Joins by order and more keep to it only if Spark need not deal rows
    out by all keys (a setting of the session); orders are many and small, so no part is much larger than others."""
    keep_to_order(df.sparkSession)
    return df.repartition(key)


def keep_to_order(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def order_lines(spark, sf):
    """The suppliers and parts of each order, once each."""
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("sent_id"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()


def order_parts(spark, sf, *kinds):
    """(sent_id, kind, s, p), once each: kind 0 is an order, 1 a supplier in it, 2 a supplier's part in it. One table, not a
    union, which would forget how its rows are dealt out."""
    every = {0: (F.lit(None), F.lit(None)), 1: (F.col("s"), F.lit(None)), 2: (F.col("s"), F.col("p"))}
    keys = by_order(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sent_id"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), "sent_id")
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), every[k][0].cast("long").alias("s"), every[k][1].cast("long").alias("p")) for k in kinds))
    return keys.select("sent_id", F.inline(rows)).distinct()


def named(prefix: str, *columns) :
    return F.concat(F.lit(prefix), F.concat_ws("x", *(F.col(c).cast("string") for c in columns)))


def tree_nodes(spark, sf):
    """order > supplier > part, as one graph for each order."""
    kinds = F.array(*map(F.lit, ("building", "machinery", "automobile", "furniture", "household")))
    of = lambda order, supplier, part: F.when(F.col("kind") == 0, order).when(F.col("kind") == 1, supplier).otherwise(part)
    id = of(named("r", "sent_id"), named("n", "s"), named("c", "s", "p"))
    return order_parts(spark, sf, 0, 1, 2).select("sent_id", id.alias("node_id"), of(F.lit("order"), named("maker", "s"), F.get(kinds, (F.col("p") % 5).cast("int"))).alias("concept"))


def tree_edges(spark, sf):
    top = F.col("kind") == 1
    src, dst = F.when(top, named("r", "sent_id")).otherwise(named("n", "s")), F.when(top, named("n", "s")).otherwise(named("c", "s", "p"))
    label = F.when(top, ":part").when(F.col("p") % 7 == 0, ":mod-of").otherwise(":op")
    return order_parts(spark, sf, 1, 2).select("sent_id", src.alias("src"), label.alias("label"), dst.alias("dst"), F.when(top, F.col("s")).otherwise(F.col("p")).alias("ord"))


def edge_scores(spark, sf):
    """Scored edges order > supplier with the return flag as label; at most two of a label leave a node."""
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("sent_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.concat(F.lit(":"), "l_returnflag").alias("label"))
    best = lines.agg(F.round(F.max("l_discount") - 0.05, 4).alias("score"))
    return best.select("sent_id", F.lit("o").alias("src"), "label", "dst", "score", F.lit(2).alias("max_card"))


def events(spark, sf):
    """A user's events as the tokens of one sentence, in order of time."""
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf, "events").select(F.col("user_id").alias("sent_id"), idx.alias("idx"), F.col("event_type").alias("tok"), "value")


def span_candidates(spark, sf):
    """Candidate spans of one to three tokens over the events, scored by the value."""
    e = events(spark, sf)
    size = (F.col("idx") % 3 + 1).cast("int")
    c = e.select("sent_id", F.col("idx").alias("start"), (F.col("idx") + size).alias("stop"), F.col("tok").alias("frag"), F.round("value", 4).alias("score"))
    d = e.select("sent_id", F.greatest(F.lit(0), F.col("idx") - 1).alias("start"), (F.col("idx") + 1).alias("stop"), F.concat("tok", F.lit("-01")).alias("frag"), F.round(F.col("value") / 2, 4).alias("score"))
    return c.unionByName(d)


def vectors(spark, sf, source: str):
    """(feature, label, value): part features by brand, from even or odd order lines."""
    lines = read(spark, sf, "lineitem").where(F.col("l_linenumber") % 2 == (0 if source == "a" else 1))
    return lines.groupBy(F.concat(F.lit("p"), (F.col("l_partkey") % 500).cast("string")).alias("feature"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("label")).agg(F.round(F.sum("l_tax"), 6).alias("value"))


#: DuckDB's twins of the views above, as common table expressions.
SQL = {
    "sent": r"sent AS (SELECT doc_id AS sent_id, [w for w in regexp_split_to_array(text, '[ \n]') if w <> ''] AS words FROM documents)",
    "tok": "tok AS (SELECT sent_id, CAST(unnest(range(len(words))) AS INTEGER) AS idx, unnest(words) AS tok FROM sent)",
    "pairs": "pairs AS (SELECT p_name AS phrase, '(thing :mod ' || lower(p_type) || ')' AS frag, l_orderkey AS sent FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "tn": """tl AS (SELECT DISTINCT l_orderkey AS sent_id, l_suppkey AS s, l_partkey AS p FROM lineitem),
      tn AS (SELECT DISTINCT sent_id, 'r' || sent_id AS node_id, 'order' AS concept FROM tl UNION ALL SELECT DISTINCT sent_id, 'n' || s, 'maker' || s FROM tl
      UNION ALL SELECT sent_id, 'c' || s || 'x' || p, ['building', 'machinery', 'automobile', 'furniture', 'household'][p % 5 + 1] FROM tl)""",
    "te": """te AS (SELECT DISTINCT l_orderkey AS sent_id, 'r' || l_orderkey AS src, ':part' AS label, 'n' || l_suppkey AS dst, l_suppkey AS ord FROM lineitem
      UNION ALL SELECT DISTINCT l_orderkey, 'n' || l_suppkey, CASE WHEN l_partkey % 7 = 0 THEN ':mod-of' ELSE ':op' END, 'c' || l_suppkey || 'x' || l_partkey, l_partkey FROM lineitem)""",
    "sc": "sc AS (SELECT l_orderkey AS sent_id, 'o' AS src, ':' || l_returnflag AS label, 's' || l_suppkey AS dst, round(max(l_discount) - 0.05, 4) AS score, 2 AS max_card FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag)",
    "ev": "ev AS (SELECT user_id AS sent_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, event_type AS tok, value FROM events)",
    "cand": """cand AS (SELECT sent_id, idx AS start, idx + idx % 3 + 1 AS stop, tok AS frag, round(value, 4) AS score FROM ev
      UNION ALL SELECT sent_id, greatest(0, idx - 1), idx + 1, tok || '-01', round(value / 2, 4) FROM ev)""",
    "va": "va AS (SELECT 'p' || (l_partkey % 500) AS feature, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS label, round(sum(l_tax), 6) AS value FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL)",
    "vb": "vb AS (SELECT 'p' || (l_partkey % 500) AS feature, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS label, round(sum(l_tax), 6) AS value FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL)",
}


def sql(body: str, *names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + (", " if names and body.lstrip()[:6].upper() != "SELECT" else " ") + body if names else body
