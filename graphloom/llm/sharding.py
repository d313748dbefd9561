"""Uniform sharding by a hypergeometric communication matrix, in DataFrame operations only.

Rows are dealt at random into source blocks. How many rows block *p* sends to shard *s* is a draw from
the multivariate hypergeometric law with the block sizes and the exact shard sizes as margins, which is
the law these counts have under a uniform permutation of all rows. The matrix is drawn by halving the
list of blocks again and again: the counts of the left half are drawn from its parent's shard counts,
so every level is one projection and a level's nodes are drawn in parallel. Each block then permutes
its rows, sends the prescribed counts, and each shard permutes what it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, without

#: Rows of a source block, and of a range of slots, that a task sorts: their numbers grow with the table.
TOGETHER = 100_000
#: Half-width of the window of the drawn law, in standard deviations: beyond lies less than 1e-31.
SPREAD = 12


def unit(seed: int, *parts: str) -> str:
    """SQL for a number in [0, 1) that depends on ``seed`` and ``parts`` only."""
    return f"(shiftrightunsigned(xxhash64({', '.join([str(seed), *parts])}), 11) * {2.0**-53!r}D)"


def hypergeometric(population: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the marked rows among ``drawn`` of ``population``, by inversion of the distribution at ``u``.

    Weights come from the ratio of neighbours, from the window's lower end up; they are summed once for
    the norm and once more up to ``u``. The arrays of one element name a value inside an expression.
    """
    low, high = "greatest(0L, s.n + s.k - s.p)", "least(s.n, s.k)"
    mode = "floor((s.n + 1D) * (s.k + 1D) / (s.p + 2D))"
    reach = f"(ceil({SPREAD} * sqrt(double(s.n) * s.k / greatest(s.p, 1) * (s.p - s.k) / greatest(s.p, 1) * (s.p - s.n) / greatest(s.p - 1, 1))) + 20)"
    law = f"transform(array(named_struct('p', {population}, 'k', {marked}, 'n', {drawn})), s -> named_struct('p', s.p, 'k', s.k, 'n', s.n, 'a', greatest({low}, {mode} - {reach}), 'b', least({high}, {mode} + {reach})))"
    step = "z.w * (s.k - x) * (s.n - x) / ((x + 1) * (s.p - s.k - s.n + x + 1))"
    norm = f"aggregate(sequence(s.a, s.b), named_struct('w', 1D, 'c', 0D), (z, x) -> named_struct('w', {step}, 'c', z.c + z.w), z -> z.c)"
    below = f"aggregate(sequence(s.a, s.b), named_struct('w', 1D, 'c', 0D, 'x', 0L), (z, x) -> named_struct('w', {step}, 'c', z.c + z.w, 'x', z.x + if(z.c + z.w < s.t, 1L, 0L)), z -> z.x)"
    normed = f"transform({law}, s -> named_struct('p', s.p, 'k', s.k, 'n', s.n, 'a', s.a, 'b', s.b, 't', {u} * {norm}))"
    return f"transform({normed}, s -> least(s.a + {below}, s.b))[0]"


def split_counts(columns: str, rows: str, node: str, seed: int) -> str:
    """SQL for the counts by shard of ``rows`` rows drawn at random from ``columns`` rows by shard."""
    rest = f"aggregate(slice({columns}, size(done) + 1, size({columns})), 0L, (y, v) -> y + v)"
    left = f"({rows} - aggregate(done, 0L, (y, v) -> y + v))"
    return f"aggregate({columns}, cast(array() as array<bigint>), (done, m) -> concat(done, array({hypergeometric(rest, 'm', left, unit(seed, node, 'size(done)'))})))"


def communication_matrix(sizes: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """One row per block (``blk``) with ``upto``: running counts of the rows that go to shards 0, 1, ...

    ``sizes`` has a row (``blk``, ``n``) for each block that holds rows, at most ``blocks`` of them, so the one
    row that the recursion starts from is bounded by the parameter and not by the data.
    """
    node = sizes.agg(F.sort_array(F.collect_list(F.struct("blk", "n"))).alias("cells"), F.sum("n").alias("rows")).where("rows > 0")
    node = node.selectExpr("cells", f"transform(sequence(0, {shards - 1}), s -> rows div {shards} + if(s < rows % {shards}, 1L, 0L)) as columns", "1L as node")
    depth = max(1, (blocks - 1).bit_length())
    for level in range(depth):
        if level == 5:
            node = node.repartition(32, "node")
        node = node.selectExpr("*", "int(size(cells) div 2) as half", "aggregate(slice(cells, 1, int(size(cells) div 2)), 0L, (y, c) -> y + c.n) as taken")
        node = node.selectExpr("*", f"if(half > 0, {split_counts('columns', 'taken', 'node', seed)}, null) as part")
        kept = "array(named_struct('cells', cells, 'columns', columns, 'node', node))"
        halves = "array(named_struct('cells', slice(cells, 1, half), 'columns', part, 'node', node * 2), named_struct('cells', slice(cells, half + 1, size(cells)), 'columns', zip_with(columns, part, (a, b) -> a - b), 'node', node * 2 + 1))"
        node = node.selectExpr(f"inline(if(half > 0, {halves}, {kept}))")
    return node.selectExpr("cells[0].blk as blk", "transform(columns, (c, s) -> aggregate(slice(columns, 1, s + 1), 0L, (y, v) -> y + v)) as upto")


def shuffle_into_shards(df: DataFrame, shards: int, *, seed: int = 7, blocks: int | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard), a uniform shuffle.

    Law of the shards: exact sizes, at most one row apart. Every row counts on its own: nulls in any
    column, equal texts and repeated rows are dealt like all others, and an empty table gives an empty
    result. Input columns named ``shard`` or ``slot`` are replaced.

    ``blocks`` source blocks (512 at least) and ``parts`` ranges of slots in each shard (64 at least) bound the rows that one
    task sorts; unless they are given there are so many that each holds about ``TOGETHER`` rows. Rows get their
    numbers before the first exchange and are written to the shared folder with them, so a lost executor changes no draw.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    own = without(df, ("shard", "slot"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows = cut(rows)
    n = rows.count()  # one number
    blocks = blocks or max(512, -(-n // TOGETHER))
    parts = parts or max(64, -(-n // (shards * TOGETHER)))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(blocks)))
    matrix = communication_matrix(rows.groupBy("blk").agg(F.count("*").alias("n")), shards, blocks, seed + 1)
    at = F.row_number().over(Window.partitionBy("blk").orderBy(F.xxhash64(F.lit(seed + 2), "rid"), "rid")) - 1
    dealt = rows.withColumn("at", at).join(matrix, "blk")
    dealt = dealt.select("row", "rid", F.size(F.filter("upto", lambda c: c <= F.col("at"))).alias("shard"))
    dealt = dealt.withColumn("key", F.xxhash64(F.lit(seed + 3), "rid")).withColumn("part", F.pmod(F.shiftright("key", 32), F.lit(parts)))
    dealt = cut(dealt)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "rid")) - 1
    placed = dealt.withColumn("within", within).join(starts, ["shard", "part"])
    return placed.select("row.*", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))
