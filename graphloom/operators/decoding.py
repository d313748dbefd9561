"""Stage-1 covers and the relational part of edge decoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import spans


def chart(candidates: DataFrame) -> DataFrame:
    """The best candidate for each (sent_id, stop): scores of zero or more, ties to the later start, then the fragment."""
    w = Window.partitionBy("sent_id", "stop").orderBy(F.desc("score"), F.desc("start"), "frag")
    return candidates.where("score >= 0").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


#: Cells of a sentence that are walked at a time.
WALK = 256


def cover(cells: DataFrame) -> DataFrame:
    """The greedy cover from the right: a cell is kept if it stops at or before the start of the last one kept.

    Scores are not added along a path. One aggregation gathers a sentence's cells (one for each token at most), and a
    fold over them by descending stop keeps the cover. The fold writes one flag for each cell, in strings of ``WALK``
    flags, so that a long sentence's flags are not copied for each cell.
    """
    gathered = cells.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("stop", "start", "frag", "score")), asc=False).alias("cells"))
    flags = F.expr(f"""
        aggregate(sequence(0, cast((size(cells) - 1) div {WALK} as int)), named_struct('edge', 2147483647, 'parts', cast(array() as array<string>)),
                  (y, b) -> aggregate(slice(cells, b * {WALK} + 1, {WALK}), named_struct('edge', y.edge, 'flags', ''),
                                      (z, c) -> if(c.stop <= z.edge, named_struct('edge', c.start, 'flags', concat(z.flags, '1')), named_struct('edge', z.edge, 'flags', concat(z.flags, '0'))),
                                      z -> named_struct('edge', z.edge, 'parts', array_append(y.parts, z.flags))),
                  y -> array_join(y.parts, ''))""")
    kept = gathered.withColumn("flags", flags).select("sent_id", F.inline(F.expr("filter(cells, (c, i) -> substring(flags, i + 1, 1) = '1')")))
    return kept.select("sent_id", "start", "stop", "frag", "score")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def walk(start: pa.Array, stop: pa.Array, frag: pa.Array, score: pa.Array) -> pa.Array:
    return spans.walked_rows(start, stop, frag, score)


def best_spans(candidates: DataFrame) -> DataFrame:
    """``cover(chart(candidates))`` with one exchange: a sentence's candidates are gathered, and the chart and the walk are made in their row."""
    one = F.struct("start", "stop", "frag", "score")
    gathered = candidates.where("score >= 0 and stop is not null").groupBy("sent_id").agg(F.collect_list(one).alias("c"))
    kept = walk(*(F.col("c")[x] for x in ("start", "stop", "frag", "score")))
    return gathered.select("sent_id", F.inline(F.transform(kept, lambda k: F.get("c", k))))


def oracle_candidates(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates that some gold span asks for."""
    return candidates.join(gold, ["sent_id", "start", "stop", "frag"], "left_semi")


def span_cost(candidates: DataFrame, gold: DataFrame, precision: float, scale: float = 1.0, kind: int = 3) -> DataFrame:
    """Candidates with ``cost``.

    Kind 2: right spans are credited 1 - precision, wrong ones cost precision. Kind 3 costs only what the gold could
    have had: a wrong fragment on a gold span costs if the right one is among the candidates and is credited if it
    cannot be reached; a span without gold costs.
    """
    g = gold.select("sent_id", "start", "stop", F.col("frag").alias("gold"))
    c = candidates.join(g, ["sent_id", "start", "stop"], "left")
    w = Window.partitionBy("sent_id", "start", "stop")
    right = F.col("gold").isNotNull() & (F.col("gold") == F.col("frag"))
    reachable = F.max(F.coalesce(right, F.lit(False))).over(w)
    credit, fault = F.lit(-(1 - precision) * scale), F.lit(precision * scale)
    if kind == 2:
        cost = F.when(right, credit).otherwise(fault)
    else:
        cost = F.when(right, credit).when(F.col("gold").isNull(), fault).when(reachable, fault).otherwise(credit)
    return c.withColumn("cost", cost)


def normal_entity(frag: Column) -> Column:
    return F.regexp_replace(frag, r"^\([^ ]* :name \(name ", "(entity ")


def pair_scores(nodes: DataFrame, labels: DataFrame, features: DataFrame, weights: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """(sent_id, src, dst, label, score): for each pair of different nodes and each label the weights of its features, added up.

    ``features`` has sent_id, src, dst, feature, u, c and, if they come from ``edgefeatures``, labels; ``weights`` feature, label
    (null: unconjoined), value. An unconjoined weight counts u times for every label, and once for the labels of the
    feature's group; a weight with a label counts c times for it. Features without a weight never meet one, so
    nothing is computed for them. ``costs`` (sent_id, feature, label, value) are weights of one sentence. Every label of
    the set is scored, however many there are.
    """
    features = features if "labels" in features.columns else features.withColumn("labels", F.lit(None).cast("string"))
    keys = ["sent_id", "src", "dst"]
    met = features.join(small(weights.select("feature", "label", "value")), "feature")
    if costs is not None:
        met = met.unionByName(features.join(costs.select("sent_id", "feature", "label", "value"), ["sent_id", "feature"]))
    # One pass over what is met: sums for the pair, for a group of labels, and for a label.
    kind = F.when(F.col("label").isNotNull(), F.struct(F.lit(None).cast("string").alias("labels"), F.col("label").alias("own"))).otherwise(F.struct("labels", F.lit(None).cast("string").alias("own")))
    sums = met.groupBy(*keys, kind.alias("of")).agg(F.sum(F.col("u") * F.col("value")).alias("u"), F.sum(F.col("c") * F.col("value")).alias("c"), F.sum("value").alias("g"))
    part = lambda cond, value, key: F.map_from_entries(F.filter(F.collect_list(F.when(cond, F.struct(key.alias("k"), value.alias("v")))), lambda x: x.isNotNull()))
    own, group = F.col("of.own"), F.col("of.labels")
    per = sums.groupBy(*keys).agg(F.sum(F.when(own.isNull(), F.col("u"))).alias("s"), part(own.isNull() & group.isNotNull(), F.col("g"), group).alias("g"), part(own.isNotNull(), F.col("c"), own).alias("t"))
    a, b = nodes.select("sent_id", F.col("node_id").alias("src")), nodes.select("sent_id", F.col("node_id").alias("dst"))
    pairs = a.join(b, "sent_id").where("src <> dst").join(per, keys, "left")
    # A label set is short: it is sent to every pair, which finds its sums in its own row.
    grouped = F.broadcast(labels.select("label", label_group(F.col("label")).alias("group")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.crossJoin(grouped).select(*keys, "label", (zero("s") + zero(F.try_element_at("g", F.col("group"))) + zero(F.try_element_at("t", F.col("label")))).alias("score"))


#: Rows of a table of weights up to which it is sent to the features, which else are dealt out by name.
SENT = 200_000


def small(weights: DataFrame) -> DataFrame:
    """``weights``, marked to be sent everywhere if they are few. Spark cannot tell that of a written table or of given rows."""
    return F.broadcast(weights) if weights.limit(SENT + 1).count() <= SENT else weights


def label_group(label: Column) -> Column:
    """The group of labels that some unconjoined weights count for."""
    return F.when(label.startswith(":ARG"), "ARG").otherwise("other")


def top_labels(scores: DataFrame) -> DataFrame:
    """Alg1: for each node and label the best ``max_card`` positive edges, ties to the smaller end."""
    w = Window.partitionBy("sent_id", "src", "label").orderBy(F.desc("score"), "dst")
    return scores.where("score > 0").withColumn("k", F.row_number().over(w)).where("k <= max_card").drop("k")


def best_labels(scores: DataFrame) -> DataFrame:
    """The best label of each ordered pair, ties to the smaller label."""
    w = Window.partitionBy("sent_id", "src", "dst").orderBy(F.desc("score"), "label")
    return scores.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def best_root(nodes: DataFrame) -> DataFrame:
    """The node of the best root score among those that are not constants; without any, the first node."""
    from graphloom.operators.graphs import is_constant

    w = Window.partitionBy("sent_id").orderBy(is_constant(F.col("concept")), F.when(is_constant(F.col("concept")), 0.0).otherwise(-F.col("score")), "node_id")
    return nodes.withColumn("k", F.row_number().over(w)).where("k = 1").select("sent_id", "node_id")
