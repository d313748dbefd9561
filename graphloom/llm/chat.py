"""Chat formatting of reply trees.

Messages point to the message they answer. Paths from the root are enumerated by iterative self-joins
that double the length known of each path, so a chain of n messages takes log n joins. Leaves are ranked
by the sum of scores along their paths, and each chosen path is written as one conversation by a
template that marks turns; control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut

#: The template's fixed strings: a turn's start, its end, and the character that escapes.
START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"


def escape(text: Column) -> Column:
    """No ``<|`` and no line feed after a role is left inside; undone by ``unescape``."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit("<|"), F.lit("<" + ESCAPE + "p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<" + ESCAPE + "p"), F.lit("<|")), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n")))


def chain(messages: DataFrame, tree: str, order: list) -> DataFrame:
    """Linear conversations as trees: ``node`` numbers a conversation's rows in ``order``, ``parent`` is the one before."""
    w = Window.partitionBy(tree).orderBy(*order)
    node = F.row_number().over(w).cast("long")
    return messages.withColumn("node", node).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def leaf_paths(tree: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, node, above): the messages on each chosen root-to-leaf path, ``above`` steps over its leaf.

    ``tree`` has ``tree``, ``node``, ``parent`` (null at a root) and ``score``. Messages whose ancestors do not lead
    to a root (a missing parent, a cycle) are on no path. Paths of one tree are ranked by the sum of scores,
    ties to the smaller leaf; ``best`` keeps so many for each tree.

    Round i joins each (leaf, ancestor) pair with the ancestor's ancestor 2^i steps up, so what is held is
    the links and the pairs of the result; the rounds are the logarithm of the largest tree.
    """
    links = cut(tree.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("tree is not null and node is not null"))
    largest = links.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    parents = links.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    pairs = links.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    jumps = links.where("parent is not null").select("tree", "node", F.col("parent").alias("up"))
    for i in range(max(0, int(largest) - 1).bit_length()):
        reached = pairs.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + 2**i).alias("above"))
        pairs = cut(pairs.unionByName(reached))
        onward = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        jumps = cut(jumps.join(onward, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")))
    on = pairs.join(links, ["tree", "node"])
    paths = on.groupBy("tree", "leaf").agg(F.sum("score").alias("sum"), F.max(F.col("parent").isNull()).alias("rooted")).where("rooted")
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return pairs.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])


def format_chats(tree: DataFrame, *, best: int | None = 1, trained_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, spans): one row per chosen path; ``spans`` are the loss mask.

    ``tree`` has tree, node, parent, role, text and score. Null texts and roles are empty. ``spans`` holds
    (start, length) in code points of the escaped texts of ``trained_role`` turns inside ``formatted``. A tree may be
    a struct, whose null members have equals. Messages with a null tree or node are on no path; repeated (tree, node) pairs are an error of the caller's keys and give each
    combination. An empty table gives no rows. A path is one row, as long as its conversation.
    """
    messages = tree.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paths = leaf_paths(tree, best).join(messages, ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turn = F.struct((-F.col("above")).alias("at"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("trained"))
    chats = paths.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    tail = len(END) + 1
    at = F.expr(f"aggregate(turns, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>)), (z, t) -> named_struct('at', z.at + length(t.head) + length(t.body) + {tail}, 'spans', if(t.trained, concat(z.spans, array(named_struct('start', z.at + length(t.head), 'length', length(t.body)))), z.spans)), z -> z.spans)")
    return chats.select("tree", "leaf", "rank", formatted.alias("formatted"), at.alias("spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, read from its marks alone."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, 2, F.size(parts))

    def turn(part):
        body = F.substring(part, F.lit(1), F.length(part) - len(END) - 1)
        line = F.instr(body, "\n")
        return F.struct(unescape_role(F.substring(body, F.lit(1), line - 1)).alias("role"), unescape(F.substring(body, line + 1, F.length(body))).alias("text"))

    return F.transform(parts, turn)
