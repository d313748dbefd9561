"""Meaning graphs as node, edge and span tables keyed by ``sent_id``.

node(sent_id, node_id, var, concept), edge(sent_id, src, label, dst, ord), span(sent_id, span_id, start, stop,
node_ids, coref). Sentences are independent, so every window and join has ``sent_id`` first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, so that later rounds do not compute it again.

    The folder is ``spark.checkpoint.dir``. Only where everything runs in one process may it be unset.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set, and a local folder would not reach the executors")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def is_constant(concept: Column) -> Column:
    return concept.rlike('^("|[0-9]|-$)')


def normalize_mod(label: Column) -> Column:
    return F.when(label == ":mod-of", ":domain").when(label == ":domain-of", ":mod").otherwise(label)


def normalize_inverse(edges: DataFrame, domain: bool = False) -> DataFrame:
    """``X :r-of Y`` becomes ``Y :r X``; with ``domain`` also ``X :domain Y`` becomes ``Y :mod X``."""
    inverse = F.col("label").endswith("-of")
    turn = inverse | (F.col("label") == ":domain") if domain else inverse
    label = F.when(inverse, F.regexp_replace("label", "-of$", ""))
    if domain:
        label = label.when(F.col("label") == ":domain", ":mod")
    rest = [c for c in edges.columns if c not in ("src", "label", "dst")]
    return edges.select(*rest, F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), label.otherwise(F.col("label")).alias("label"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def with_inverses(edges: DataFrame) -> DataFrame:
    """Edges in both directions; an inverse has ``-of`` added or taken away."""
    flip = F.when(F.col("label").endswith("-of"), F.regexp_replace("label", "-of$", "")).otherwise(F.concat("label", F.lit("-of")))
    back = edges.select("sent_id", F.col("dst").alias("src"), flip.alias("label"), F.col("src").alias("dst"))
    return edges.select("sent_id", "src", "label", "dst").unionByName(back)


def number_ops(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``:op`` children numbered by where their spans start; ``:op1`` to ``:opn`` take the first places of a node.

    A child without a start comes after those with one.
    """
    w = Window.partitionBy("sent_id", "src").orderBy(F.col("start").asc_nulls_last(), "dst")
    ops = edges.where("label = ':op'").join(starts, ["sent_id", "dst"], "left")
    ops = ops.select("sent_id", "src", F.concat(F.lit(":op"), F.row_number().over(w).cast("string")).alias("label"), "dst", (F.row_number().over(w) - 1_000_000).alias("ord"))
    return edges.where("label <> ':op'").select("sent_id", "src", "label", "dst", "ord").unionByName(ops)


def sort_relations(edges: DataFrame) -> DataFrame:
    """Children in the order of their labels, stable."""
    w = Window.partitionBy("sent_id", "src").orderBy("label", "ord")
    return edges.withColumn("ord", F.row_number().over(w) - 1)


#: Nodes of a sentence up to which its ways are followed, and fragments written, inside one row.
ROW = 64


def by_size(nodes: DataFrame, node: str, *others: DataFrame) -> tuple[tuple, tuple | None]:
    """``nodes`` and ``others`` of the sentences that fit a row (``ROW`` nodes, each once), and those of all other sentences.

    The second is None if there are none. Counting takes a hash of each node; two nodes with one hash go with the others.
    """
    count = nodes.groupBy("sent_id").agg(F.count("*").alias("n"), F.size(F.collect_set(F.xxhash64(node))).alias("different"))
    large = cut(count.where((F.col("n") > ROW) | (F.col("different") < F.col("n"))).select("sent_id"))
    tables = (nodes, *others)
    if not large.limit(1).count():
        return tables, None
    return tuple(t.join(large, "sent_id", "left_anti") for t in tables), tuple(t.join(large, "sent_id", "left_semi") for t in tables)


def climb(nodes: DataFrame, join) -> DataFrame:
    """(sent_id, node, own): what ``join`` makes of the ``own`` values on the way from each node to its root.

    ``nodes`` has sent_id, node, up (null at a root) and own. What is known of a way is joined with what is known of the
    rest of it, so a depth of n takes log n rounds: in the row of a sentence of few nodes, else over written tables.
    Nodes whose way up ends at a missing node, or in a circle, have no row.
    """
    nodes = nodes.select("sent_id", "node", "up", "own")
    (small,), large = by_size(nodes, "node")
    found = climb_in_row(small, join)
    return found if large is None else found.unionByName(climb_tables(large[0], join))


def climb_in_row(nodes: DataFrame, join) -> DataFrame:
    """``climb`` for sentences of few nodes: a row for each, in which a node's way leads to a place of the row (0: nowhere)."""
    rows = nodes.groupBy("sent_id").agg(F.collect_list(F.struct("node", "up", "own")).alias("all"))
    rows = rows.withColumn("ways", F.transform("all", lambda x: F.struct(F.array_position(F.col("all.node"), x["up"]).cast("int").alias("up"), x["own"].alias("own"))))

    def further(ways, _):
        def on(x):
            above = F.get(ways, x["up"] - 1)
            moves = F.coalesce(x["up"] > 0, F.lit(False))
            return F.struct(F.when(moves, above["up"]).otherwise(x["up"]).alias("up"), F.when(moves, join(above["own"], x["own"])).otherwise(x["own"]).alias("own"))

        return F.transform(ways, on)

    # A way of n nodes ends after log n rounds; one more tells circles, which never end.
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("all"))).cast("int"))
    ended = rows.select("sent_id", F.arrays_zip(F.col("all.node").alias("node"), F.aggregate(rounds, F.col("ways"), further).alias("way")).alias("all"))
    return ended.select("sent_id", F.inline(F.filter("all", lambda x: x["way"]["up"].isNull()))).select("sent_id", "node", F.col("way.own").alias("own"))


def climb_tables(nodes: DataFrame, join) -> DataFrame:
    """``climb`` by one equi-join by (sent_id, node), one table and one count a round, for sentences of any size."""
    now = cut(nodes)
    left = now.where("up is not null").count()
    while left:
        above = now.select("sent_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("own").alias("above"))
        moved = now.where("up is not null").join(above, ["sent_id", "up"]).select("sent_id", "node", F.col("next").alias("up"), join(F.col("above"), F.col("own")).alias("own"))
        now = cut(now.where("up is null").unionByName(moved))
        # Each round ends the ways of up to twice the length; if it ends none, what is left hangs on circles.
        before, left = left, now.where("up is not null").count()
        if left == before:
            break
    return now.where("up is null").select("sent_id", "node", "own")


def gorn_ids(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(sent_id, node, gorn): the root is 0, the i-th tree child of x is x.i, for trees of any depth and number."""
    w = Window.partitionBy("sent_id", "src").orderBy("ord", "dst")
    children = edges.select("sent_id", F.col("dst").alias("node"), F.col("src").alias("up"), (F.row_number().over(w) - 1).cast("string").alias("own"))
    tops = roots.select("sent_id", "node", F.lit(None).cast(children.schema["up"].dataType).alias("up"), F.lit("0").alias("own"))
    return climb(tops.unionByName(children), lambda above, own: F.concat(above, F.lit("."), own)).withColumnRenamed("own", "gorn")


def preorder(ids: DataFrame) -> DataFrame:
    """Nodes with their place in a depth-first walk: the numeric order of Gorn ids."""
    key = F.transform(F.split("gorn", "[.]"), lambda x: x.cast("int"))
    return ids.withColumn("place", F.row_number().over(Window.partitionBy("sent_id").orderBy(key)))


def clear_unaligned(nodes: DataFrame, edges: DataFrame, aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a span, and the edges between two of them."""
    kept = nodes.join(aligned, ["sent_id", "node_id"], "left_semi")
    ends = kept.select("sent_id", "node_id")
    inner = edges.join(ends.withColumnRenamed("node_id", "src"), ["sent_id", "src"], "left_semi").join(ends.withColumnRenamed("node_id", "dst"), ["sent_id", "dst"], "left_semi")
    return kept, inner.select("sent_id", "src", "label", "dst")


def unaligned(nodes: DataFrame, aligned: DataFrame) -> DataFrame:
    return nodes.join(aligned, ["sent_id", "node_id"], "left_anti")


def primary_spans(spans: DataFrame) -> DataFrame:
    """(sent_id, node_id, span_id): a node's first span, those that are not coreferences before others."""
    of = spans.select("sent_id", "span_id", "coref", F.explode("node_ids").alias("node_id"))
    return of.groupBy("sent_id", "node_id").agg(F.min(F.struct("coref", "span_id")).alias("m")).select("sent_id", "node_id", F.col("m.span_id").alias("span_id"))


def fragment_edges(edges: DataFrame, primary: DataFrame) -> DataFrame:
    """Edges inside one fragment: both ends have the same primary span."""
    a = primary.select("sent_id", F.col("node_id").alias("src"), F.col("span_id").alias("a"))
    b = primary.select("sent_id", F.col("node_id").alias("dst"), F.col("span_id").alias("b"))
    return edges.join(a, ["sent_id", "src"]).join(b, ["sent_id", "dst"]).where("a = b").select("sent_id", "src", "label", "dst")


def span_words(spans: DataFrame) -> DataFrame:
    """(sent_id, idx, spans): the spans that cover each token."""
    long = spans.where("start < stop").select("sent_id", "span_id", F.explode(F.sequence("start", F.col("stop") - 1)).alias("idx"))
    return long.groupBy("sent_id", "idx").agg(F.sort_array(F.collect_list("span_id")).alias("spans"))


def format_span(start: Column, stop: Column, node_ids: Column, coref: Column) -> Column:
    """``[*]s-e|id+id``, node ids in the order of strings; a deleted span is the empty string."""
    text = F.concat(F.when(coref, "*").otherwise(""), start.cast("string"), F.lit("-"), stop.cast("string"), F.lit("|"), F.array_join(F.array_sort(node_ids), "+"))
    return F.when(start < stop, text).otherwise("")


def load_spans(df: DataFrame, id: str, alignments: str) -> DataFrame:
    """Spans of an alignment string; ``bad`` marks what has not the form ``[*]s-e|ids``."""
    parts = df.select(F.col(id).alias("sent_id"), F.posexplode(F.filter(F.split(F.col(alignments), " +"), lambda x: x != "")).alias("span_id", "raw"))
    at = lambda k: F.regexp_extract("raw", r"^(\*?)([0-9]+)-([0-9]+)\|(.+)$", k)
    return parts.select("sent_id", "span_id", at(2).try_cast("int").alias("start"), at(3).try_cast("int").alias("stop"), F.array_sort(F.split(at(4), "[+]")).alias("node_ids"), (at(1) == "*").alias("coref"), (at(2) == "").alias("bad"))


def unify_variables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose leaf has a known variable as its concept lead to that variable's node instead."""
    named = nodes.where("var is not null").select("sent_id", F.col("var").alias("concept"), F.col("node_id").alias("target"))
    parents = edges.select("sent_id", F.col("src").alias("node_id")).distinct()
    leaves = nodes.join(parents, ["sent_id", "node_id"], "left_anti").select("sent_id", F.col("node_id").alias("dst"), "concept")
    to = leaves.join(named, ["sent_id", "concept"]).select("sent_id", "dst", "target")
    return edges.join(to, ["sent_id", "dst"], "left").select("sent_id", "src", "label", F.coalesce("target", "dst").alias("dst"), F.col("target").isNotNull().alias("reentrant"))


def name_variables(nodes: DataFrame) -> DataFrame:
    """``nodes`` with variables apart: one that an earlier node of the sentence (by ``ord``) has becomes its first letter with
    the least number from 2 on that is free, or without one if that is; nodes without a variable stay so."""
    walk = nodes.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("ord", "node_id", "var"))).alias("walk"))
    none = F.array().cast("array<string>")

    def free(first: Column, taken: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: F.when(k == 1, first).otherwise(F.concat(first, k.cast("string"))))
        return F.get(F.filter(tries, lambda t: ~F.array_contains(taken, t)), F.lit(0))

    def step(taken: Column, x: Column) -> Column:
        # Every node has a place in the list; the empty string stands for no variable.
        name = F.coalesce(x["var"], F.lit(""))
        return F.array_append(taken, F.when((name == "") | ~F.array_contains(taken, name), name).otherwise(free(F.left(name, F.lit(1)), taken)))

    named = walk.select("sent_id", F.inline(F.arrays_zip(F.col("walk.node_id").alias("node_id"), F.aggregate("walk", none, step).alias("var"))))
    return nodes.drop("var").join(named.select("sent_id", "node_id", F.nullif("var", F.lit("")).alias("var")), ["sent_id", "node_id"])


def node_rows(nodes: DataFrame) -> DataFrame:
    """Sink lines of nodes: id, concept and span, tab-separated; a node without a span ends with the tab."""
    span = F.coalesce(F.concat("start", F.lit("-"), "stop"), F.lit(""))
    return nodes.select("sent_id", F.concat_ws("\t", F.lit("# ::node"), "node_id", "concept", span).alias("line"))


def root_rows(roots: DataFrame) -> DataFrame:
    return roots.select("sent_id", F.concat_ws("\t", F.lit("# ::root"), "node_id", "concept").alias("line"))


def edge_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sink lines of edges: concepts and ids of both ends; labels lose their colon."""
    a = nodes.select("sent_id", F.col("node_id").alias("src"), F.col("concept").alias("src_concept"))
    b = nodes.select("sent_id", F.col("node_id").alias("dst"), F.col("concept").alias("dst_concept"))
    e = edges.join(a, ["sent_id", "src"]).join(b, ["sent_id", "dst"])
    return e.select("sent_id", F.concat_ws("\t", F.lit("# ::edge"), "src_concept", F.regexp_replace("label", "^:", ""), "dst_concept", "src", "dst", F.lit("")).alias("line"))


def triples(nodes: DataFrame, edges: DataFrame, detail: int = 1, extra: Column | None = None, sort: bool = True) -> DataFrame:
    """(sent_id, triples): a line for each edge; labels lose their colon.

    Detail 0 is ``(concept, relation, concept)``, 1 the same with variables, 2 ``relation(concept, concept)``, 3 the same with
    variables, and 4 or more ``(concept, concept, relation)`` with variables. ``nodes`` has node_id, concept and, from
    detail 1 on, var. ``extra`` is put after each line. Lines are sorted, or else in the order of ``ord``.
    """
    name = F.concat(F.when(F.col("var").isNull(), "").otherwise(F.concat("var", F.lit(" / "))), "concept") if detail in (1, 3) or detail > 3 else F.col("concept")
    ends = nodes.select("sent_id", "node_id", name.alias("name"))
    e = edges.join(ends.toDF("sent_id", "src", "a"), ["sent_id", "src"]).join(ends.toDF("sent_id", "dst", "b"), ["sent_id", "dst"])
    relation = F.regexp_replace("label", "^:", "")
    shapes = [("(", "a", ", ", relation, ", ", "b", ")"), ("(", "a", ", ", relation, ", ", "b", ")"), (relation, "(", "a", ", ", "b", ")"), (relation, "(", "a", ", ", "b", ")"), ("(", "a", ", ", "b", ", ", relation, ")")]
    parts = [F.col(x) if isinstance(x, str) and x in "ab" else x if isinstance(x, Column) else F.lit(x) for x in shapes[min(detail, 4)]]
    line = F.concat(*parts, F.coalesce(extra, F.lit("")) if extra is not None else F.lit(""))
    key = F.struct(line.alias("line")) if sort else F.struct("ord", line.alias("line"))
    return e.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["line"]), "\n").alias("triples"))


def canonical_fragments(nodes: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(sent_id, node_id, frag): the whole tree below each of ``roots``, children sorted by label and concept.

    This is the form in which fragments are compared. A sentence of few nodes is written in its own row; for others,
    leaves are written first, then nodes all of whose children are written, so a depth of n takes n rounds.
    """
    nodes, edges = nodes.select("sent_id", "node_id", "concept"), edges.select("sent_id", "src", "label", "dst")
    small, large = by_size(nodes, "node_id", edges, roots)
    found = fragments_in_row(*small)
    return found if large is None else found.unionByName(fragments_by_level(*large))


def written_fragments(concepts: dict, below: dict) -> dict:
    """The text below each node that has one: none if a child is missing or its way down ends in a circle."""
    texts: dict = {}
    joined = lambda *parts: " ".join(x for x in parts if x is not None)
    for top in concepts:
        todo, open_ = [top], set()
        while todo:
            at = todo[-1]
            kids = below.get(at, ())
            waiting = [x for _, x in kids if x not in texts]
            if at in texts or not waiting or at in open_ or any(x not in concepts for x in waiting):
                todo.pop()
                if at not in texts and not waiting:
                    own = sorted((joined(label, concepts[x]), joined(label, texts[x])) for label, x in kids)
                    texts[at] = f"({concepts[at]} {' '.join(x for _, x in own)})" if kids and concepts[at] is not None else concepts[at]
                continue
            open_.add(at)
            todo += waiting
    return texts


def fragments_in_row(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``canonical_fragments`` for sentences of few nodes."""
    own = nodes.groupBy("sent_id").agg(F.collect_list(F.struct("node_id", "concept")).alias("nodes"))
    ways = edges.groupBy("sent_id").agg(F.collect_list(F.struct("src", "label", "dst")).alias("edges"))
    tops = roots.groupBy("sent_id").agg(F.collect_set("node_id").alias("roots"))

    def run(batches):
        for batch in batches:
            out = []
            for sent, nodes_, edges_, roots_ in zip(*(batch.column(c).to_pylist() for c in ("sent_id", "nodes", "edges", "roots"))):
                below: dict = {}
                for e in edges_ or ():
                    below.setdefault(e["src"], []).append((e["label"], e["dst"]))
                texts = written_fragments({n["node_id"]: n["concept"] for n in nodes_}, below)
                out += [(sent, r, texts[r]) for r in roots_ if r in texts]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["sent_id", "node_id", "frag"])

    return own.join(ways, "sent_id", "left").join(tops, "sent_id").mapInArrow(run, "sent_id long, node_id string, frag string")


def fragments_by_level(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``canonical_fragments`` in rounds over written tables, for sentences of any size."""
    texts = nodes.select("sent_id", "node_id", "concept")
    tree = edges.select("sent_id", "src", "label", "dst")
    parents = cut(tree.groupBy("sent_id", F.col("src").alias("node_id")).agg(F.count("*").alias("n")))
    done = cut(texts.join(parents, ["sent_id", "node_id"], "left_anti").select("sent_id", "node_id", "concept", F.col("concept").alias("frag")))
    waiting = cut(parents)
    while waiting.limit(1).count():
        kids = tree.join(done.select("sent_id", F.col("node_id").alias("dst"), F.col("concept").alias("c"), "frag"), ["sent_id", "dst"])
        below = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.concat_ws(" ", "label", "c").alias("k"), F.concat_ws(" ", "label", "frag").alias("x")))), lambda z: z["x"]), " ")
        ready = kids.groupBy("sent_id", F.col("src").alias("node_id")).agg(F.count("*").alias("have"), below.alias("below")).join(waiting, ["sent_id", "node_id"]).where("have = n")
        new = cut(ready.join(texts, ["sent_id", "node_id"]).select("sent_id", "node_id", "concept", F.concat(F.lit("("), "concept", F.lit(" "), "below", F.lit(")")).alias("frag")))
        if not new.limit(1).count():
            break
        done, waiting = cut(done.unionByName(new)), cut(waiting.join(new.select("sent_id", "node_id"), ["sent_id", "node_id"], "left_anti"))
    return done.join(roots.select("sent_id", "node_id"), ["sent_id", "node_id"], "left_semi").select("sent_id", "node_id", "frag")


def disconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sent_id, node_id, stanza) of each named node: its variable and concept, and its edges one below the other.

    Children stand in the order of ``ord``; a child is its variable, or its concept if it has none.
    """
    ends = nodes.select("sent_id", F.col("node_id").alias("dst"), F.coalesce("var", "concept").alias("to"))
    lines = edges.join(ends, ["sent_id", "dst"]).groupBy("sent_id", F.col("src").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label", "to"))), lambda e: F.concat(F.lit("\n  "), e["label"], F.lit(" "), e["to"])), "").alias("below"))
    named = nodes.where("var is not null").join(lines, ["sent_id", "node_id"], "left")
    return named.select("sent_id", "node_id", F.concat(F.lit("("), "var", F.lit(" / "), "concept", F.coalesce("below", F.lit("")), F.lit(")")).alias("stanza"))


def not_simple(edges: DataFrame) -> DataFrame:
    """Pairs of nodes with more than one edge between them, in either direction."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    return edges.groupBy("sent_id", *pair).agg(F.count("*").alias("n")).where("n > 1")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sent_id, node_id, component): the least node that each node is connected with.

    Least labels run along the edges until none changes; labels also jump to their label's label, so long
    chains take few rounds. Each round is written to the shared folder.
    """
    both = edges.select("sent_id", F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("sent_id", "dst", "src")).distinct()
    both = cut(both)
    now = nodes.select("sent_id", "node_id", F.col("node_id").alias("component")).distinct()
    while True:
        near = both.join(now.select("sent_id", F.col("node_id").alias("b"), "component"), ["sent_id", "b"]).groupBy("sent_id", "a").agg(F.min("component").alias("m"))
        step = now.join(near.withColumnRenamed("a", "node_id"), ["sent_id", "node_id"], "left").select("sent_id", "node_id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("c"))
        onward = now.select("sent_id", F.col("node_id").alias("c"), F.col("component").alias("further"))
        step = cut(step.join(onward, ["sent_id", "c"], "left").select("sent_id", "node_id", "was", F.least("c", F.coalesce("further", "c")).alias("component")))
        if step.where("was <> component").limit(1).count() == 0:
            return step.select("sent_id", "node_id", "component")
        now = step.select("sent_id", "node_id", "component")


def has_cycle(edges: DataFrame) -> DataFrame:
    """(sent_id, cyclic): leaves are peeled off until none is left; what remains lies on or above a cycle. Each round is written."""
    rest, every = cut(edges.select("sent_id", "src", "dst").distinct()), edges.select("sent_id").distinct()
    count = rest.count()
    while count:
        heads = rest.select("sent_id", F.col("src").alias("dst")).distinct()
        rest = cut(rest.join(heads, ["sent_id", "dst"], "left_semi").select("sent_id", "src", "dst"))
        left = rest.count()
        if left == count:
            break
        count = left
    return every.join(rest.select("sent_id").distinct().withColumn("c", F.lit(True)), "sent_id", "left").select("sent_id", F.coalesce("c", F.lit(False)).alias("cyclic"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(sent_id, node, path): the nodes from each node up to its root; a node whose way up is broken has no row."""
    rows = parents.select("sent_id", "node", F.col("parent").alias("up"), F.array("node").alias("own"))
    return climb(rows, lambda above, own: F.concat(own, above)).withColumnRenamed("own", "path")


def common_suffix(a: Column, b: Column) -> Column:
    """How many nodes two root paths share, counted from the root."""
    ra, rb = F.reverse(a), F.reverse(b)
    same = F.zip_with(ra, rb, lambda x, y: F.when(x.isNull() | y.isNull(), False).otherwise(x == y))
    end = F.array_position(same, F.lit(False))
    return F.when(end == 0, F.size(same)).otherwise(end - 1).cast("int")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return (F.size(F.filter(same, lambda x: x)) - 1).cast("int")


def shared_prefixes(a: DataFrame, b: DataFrame, least: int = 4) -> DataFrame:
    """(a, b, lcp) of the words of two lists that share their first ``least`` letters or more, joined on those letters."""
    left = a.select(F.col("a"), F.left("a", F.lit(least)).alias("k")).where(F.length("a") >= least)
    right = b.select(F.col("b"), F.left("b", F.lit(least)).alias("k")).where(F.length("b") >= least)
    return left.join(right, "k").select("a", "b", common_prefix_length(F.col("a"), F.col("b")).alias("lcp"))
