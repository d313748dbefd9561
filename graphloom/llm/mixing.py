"""Mixing of sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Every source's documents are dealt to shards by a seeded hash. The documents of a source and shard (a cell) stand on a
line in seeded order, and the line is cut into blocks of equal words. The mix's blocks go to the sources by highest
quotients, a source's blocks to its shards likewise, and a cell then takes its quota of blocks by seeded choice: each
block as often as all can be, and some once more. A document's share is what its words in those blocks add up to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, let, without

#: Words of a block; a source of fewer than BLOCK * LEAST words has smaller ones, so that it has LEAST blocks or one for each word.
BLOCK, LEAST = 256, 256
#: Rows of a shard, and the least number of shards: their number grows with the table, so that no cell does.
SHARD_ROWS, SHARDS = 50_000, 64
#: No document is taken more often than this.
REPEATS = 2


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    # Only the first and the last part can be empty.
    return let(parts, lambda p: F.size(p) - F.when(p[0] == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)).cast("long")


def targets(sources: DataFrame, share: float, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (src, source_size) with ``place`` and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` times all words; a target stops at
    REPEATS times its source's size and the rest is shared again by weight: seen from the source that is full first to
    the one that is full last, a source is full if its share of what the ones before it left is no less than its limit.
    """
    # A row for each source of the mix, of a few numbers: one task ranks them.
    s = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("src.source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).cast("double")).withColumn("limit", (REPEATS * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    among = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / among).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    # The full ones come first, and the first that is not full tells the level of all others.
    return s.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))).over(every)["level"]).select(
        "src", "source_size", "place", F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def apportion(items: DataFrame, group: list[str], tie: str) -> DataFrame:
    """``items`` (votes, seats of the group) with ``quota``: the group's seats by the highest of votes / 1, / 3, / 5, ...

    Equal quotients go to the smaller ``tie``. With p seats in proportion and m items, round(p - p (m/2 + 1) / seats)
    seats are sure and none beyond round(p + p (m/2 + 1) / seats) is had, so that only about 2 m quotients are ranked.
    """
    whole = Window.partitionBy(*group)
    p = F.col("votes") * F.col("seats") / F.sum("votes").over(whole)
    room = (F.count("*").over(whole) / 2 + 1) / F.col("seats")
    near = items.where("votes > 0 and seats > 0").withColumn("p", p).withColumn("room", room)
    near = near.withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("p") * (1 - F.col("room")) + 0.5)).cast("long")).withColumn("most", F.floor(F.col("p") * (1 + F.col("room")) + 0.5).cast("long"))
    near = near.withColumn("open", F.col("seats") - F.sum("sure").over(whole))
    seat = near.where("most > sure").select(*group, tie, "open", F.col("votes"), F.explode(F.sequence("sure", F.col("most") - 1)).alias("k"))
    ranked = seat.withColumn("r", F.row_number().over(whole.orderBy(F.desc(F.col("votes") / (2 * F.col("k") + 1)), tie)))
    won = ranked.where("r <= open").groupBy(*group, tie).agg(F.count("*").alias("won"))
    keys = [*group, tie]
    sure = near.select(*keys, "sure")
    return items.join(sure, keys, "left").join(won, keys, "left").withColumn("quota", F.coalesce("sure", F.lit(0)) + F.coalesce("won", F.lit(0))).drop("sure", "won")


def mix_sources(docs: DataFrame, *, source: str = "source", size: str = "size", identity: list[str], share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), seed: int = 11) -> DataFrame:
    """``docs`` with source_size, target (words of its source in the mix) and taken (its words there, repeats counted).

    ``size`` is a row's words. ``identity`` names columns that tell rows apart: they and the seed decide places, so that
    a second run gives the same; rows that are equal in them and in size are interchangeable. Null sources are one
    source; null sizes count as 0 and such rows, like rows of size 0, take nothing; an empty table gives no rows. Very
    long texts stand in many blocks. Columns named like the output's are replaced, others stay under any name.

    A source's taken words are near its target: quotas are whole blocks. No row is taken more than REPEATS times its size.
    """
    own = without(docs, ("source_size", "target", "taken", size))
    told = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in identity))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.struct(F.col(f"`{source}`").alias("source")).alias("src"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"), F.md5(told).alias("key"))
    rows = cut(rows)
    shards = max(SHARDS, -(-rows.count() // SHARD_ROWS))  # one number
    rows = rows.withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % shards)
    cells = cut(rows.groupBy("src", "shard").agg(F.sum("size").alias("words")))
    sources = cut(targets(cells.groupBy("src").agg(F.sum("words").alias("source_size")), share, weights))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"source_size div {LEAST}")))
    cells = cells.join(sources, "src").withColumn("block", block).withColumn("blocks", F.expr("(words + block - 1) div block"))
    wanted = cells.groupBy("src", "place", "source_size", "target").agg(F.sum("blocks").alias("have")).withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("have") / F.col("source_size")).otherwise(0.0))
    wanted = wanted.withColumn("all", F.lit(1)).withColumn("seats", F.floor(F.sum("votes").over(Window.partitionBy("all")) + 0.5))
    quotas = apportion(wanted, ["all"], "place").select("src", F.least("quota", REPEATS * F.col("have")).alias("seats"))
    cells = apportion(cells.select("src", "place", "shard", "words", "blocks", "source_size", "target", F.col("blocks").cast("double").alias("votes")).join(quotas, "src"), ["src"], "shard")
    cells = cut(cells.select("src", "shard", "place", "words", "blocks", "source_size", "target", F.least("quota", REPEATS * F.col("blocks")).alias("quota")))
    # One exchange, by cell: places, blocks, their order and the sums all keep to it.
    cell = Window.partitionBy("src", "shard")
    placed = rows.withColumn("start", F.sum("size").over(cell.orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.withColumn("at", F.row_number().over(cell.orderBy("key", "size"))).join(cells, ["src", "shard"])
    first, last = F.expr("((start + 1) * blocks - 1) div words"), F.expr("((start + size) * blocks - 1) div words")
    held = placed.withColumn("j", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    held = held.withColumn("r", F.dense_rank().over(cell.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "place", "shard", "j")), "j")))
    inside = F.least(F.expr("start + size"), F.expr("(j + 1) * words div blocks")) - F.greatest(F.col("start"), F.expr("j * words div blocks"))
    times = F.expr("quota div blocks") + F.when(F.col("r") <= F.expr("quota % blocks"), 1).otherwise(0)
    held = held.groupBy("src", "shard", "at").agg(F.first("row").alias("row"), F.first("size").alias(size), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.coalesce(F.sum(F.when(F.col("j").isNotNull(), inside * times)), F.lit(0)).alias("taken"))
    return held.select("row.*", size, "source_size", "target", "taken")
