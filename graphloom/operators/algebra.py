"""Sparse vectors as long tables (feature, label, value), and what learning does with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["feature", "label"]


def add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """a + scale * b; entries that come to zero are kept out."""
    both = a.select(*KEY, "value").unionByName(b.select(*KEY, (F.col("value") * scale).alias("value")))
    return both.groupBy(*KEY).agg(F.sum("value").alias("value")).where("value <> 0")


def dot(features: DataFrame, weights: DataFrame, id: str) -> DataFrame:
    """Weighted sums by ``id``; features without a weight add nothing."""
    return features.join(weights, "feature").groupBy(id).agg(F.sum(F.col("f") * F.col("value")).alias("score"))


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """a / b where b has an entry that is not zero."""
    other = b.where("value <> 0").select(F.col("feature").alias("of"), F.col("label").alias("ol"), F.col("value").alias("by"))
    return a.join(other, F.expr("feature = of and label <=> ol")).select(*KEY, (F.col("value") / F.col("by")).alias("value"))


def keep(a: DataFrame, wanted: DataFrame) -> DataFrame:
    return a.join(wanted.select("feature").distinct(), "feature", "left_semi")


def nonzero_sorted(a: DataFrame) -> DataFrame:
    return a.where("value <> 0").orderBy("feature", "label")


def merge_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def one_line(a: DataFrame, id: str) -> DataFrame:
    """``k=v k=v`` by id, sorted."""
    return a.groupBy(id).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "feature", F.col("value").cast("string")))), " ").alias("line"))


def from_one_line(line: Column) -> Column:
    """``k=v k=v`` as a map; the value stands after the last ``=``."""
    pairs = F.transform(F.filter(F.split(line, " "), lambda x: x != ""), lambda x: F.struct(F.regexp_replace(x, "=[^=]*$", "").alias("k"), F.regexp_extract(x, "=([^=]*)$", 1).cast("double").alias("v")))
    return F.map_from_entries(pairs)


def adagrad(weights: DataFrame, squares: DataFrame, gradient: DataFrame, step: float, l2: float = 0.0, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """(weights, squares) after one step: G += g^2, w -= step * g / sqrt(G), with L2 on what the gradient touches."""
    w = weights.select(F.col("feature").alias("wf"), F.col("label").alias("wl"), F.col("value").alias("w"))
    s = squares.select(F.col("feature").alias("sf"), F.col("label").alias("sl"), F.col("value").alias("s"))
    g = gradient.where("value <> 0").select(F.col("feature").alias("gf"), F.col("label").alias("gl"), F.col("value").alias("g"))
    j = g.join(w, F.expr("gf = wf and gl <=> wl"), "full")
    # A null label is a label of its own: the side that is there is told by its feature.
    j = j.select(F.coalesce("gf", "wf").alias("feature"), F.when(F.col("gf").isNotNull(), F.col("gl")).otherwise(F.col("wl")).alias("label"), "g", F.coalesce("w", F.lit(0.0)).alias("w"))
    j = j.join(s, F.expr("feature = sf and label <=> sl"), "left").select(*KEY, "g", "w", F.coalesce("s", F.lit(0.0)).alias("s"))
    full = F.col("g") + l2 / n * F.col("w")
    j = j.withColumn("g", F.when(F.col("g").isNotNull(), full)).withColumn("s", F.col("s") + F.coalesce(F.col("g") * F.col("g"), F.lit(0.0)))
    new = F.when(F.col("g").isNull() | (F.col("s") == 0), F.col("w")).otherwise(F.col("w") - step * F.col("g") / F.sqrt("s"))
    return j.select(*KEY, new.alias("value")), j.select(*KEY, F.col("s").alias("value"))


def sgd(weights: DataFrame, gradient: DataFrame, step: float, l2: float = 0.0, unregularized=()) -> DataFrame:
    """w -= step * g, then w -= step * l2 * w, but for the features that are not regularized."""
    moved = add(weights, gradient, -step)
    kept = F.when(F.col("feature").isin(*unregularized), 1.0).otherwise(1 - step * l2) if unregularized else F.lit(1 - step * l2)
    return moved.select(*KEY, (F.col("value") * kept).alias("value"))


def scaled_sgd(weights: DataFrame, scale: float, gradient: DataFrame, step: float, l2: float, unregularized=()) -> tuple[DataFrame, float]:
    """(weights, scale) after one step, where the true weights are scale times the table: w = (1 - step * l2) w - step * g.

    L2 changes the scale alone, so that only what the gradient touches, and what is not regularized, gets a new value.
    """
    kept = 1 - step * l2
    moved = add(weights, gradient, -step / (kept * scale))
    if unregularized:
        free = F.col("feature").isin(*unregularized)
        # These keep their true value but for the gradient's part, which has no shrinking in it.
        own = gradient.where(free).select(F.col("feature").alias("gf"), F.col("label").alias("gl"), F.col("value").alias("g"))
        was = weights.where(free).select(F.col("feature").alias("wf"), F.col("label").alias("wl"), F.col("value").alias("w"))
        both = was.join(own, F.expr("wf = gf and wl <=> gl"), "full")
        fixed = both.select(F.coalesce("wf", "gf").alias("feature"), F.when(F.col("wf").isNotNull(), F.col("wl")).otherwise(F.col("gl")).alias("label"), (F.coalesce("w", F.lit(0.0)) / kept - F.coalesce("g", F.lit(0.0)) * (step / (kept * scale))).alias("value"))
        moved = moved.where(~free).unionByName(fixed)
    return moved, scale * kept


def average(passes: list[DataFrame], divide_by_passes: bool) -> DataFrame:
    """The sum of each pass's weights, or their mean."""
    total = passes[0]
    for p in passes[1:]:
        total = total.unionByName(p)
    out = total.groupBy(*KEY).agg(F.sum("value").alias("value"))
    return out.select(*KEY, (F.col("value") / len(passes)).alias("value")) if divide_by_passes else out
