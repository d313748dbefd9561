"""Stage-2 features of node pairs and roots, built inside a sentence's row and put out as a long table.

A sentence has sent_id, words, pos, rels (arrays by word), heads (array of 0-based head places, -1 at the root), srl
(array of pred, p_start, p_stop, arg, a_start, a_stop) and nodes (array of id, concept, span, start, stop, frag_head, which
is the concept of the head of the span's fragment). Nodes without words (start >= stop) have no pairs. A pair is a row
for as long as its features are made, in one step with the sentence's arrays; only what a pair emits is dealt out.

A feature has an unconjoined value ``u``, one conjoined with each label ``c``, and ``labels``: null, or the group of labels
(``ARG``: those that start with :ARG, ``other``) for which the unconjoined weight counts. More features can be
registered with ``edge_feature`` and ``root_feature``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import ways

EDGE: dict[str, Callable] = {}
ROOT: dict[str, Callable] = {}
#: Features that see, and leave for all that follow, tags with verbs and nouns (v2: more) made alike.
COARSE = {"distance", "logDistance", "posPathv1", "posPathv2", "posPathv3", "dependencyPathv3", "dependencyPathv4", "dependencyPathv5"}
#: Features that do not look at the way between two nodes: it is not searched for if no other is asked for.
PATHLESS = {"CostAugEdge", "DDEdgeId", "LRLabelWithId", "bias", "biasScaled", "edgeCount", "biasCSuf", "typeBias", "self", "fragHead", "conceptBigram", "conceptUnigramWithLabel", "srl"}
WAY = "struct<size:int,w1:int,w2:int,up:array<int>,down:array<int>>"
#: Kinds of tags that ways are spelt with.
KINDS = ("2", "3", "5")
#: Longest path, counting its highest word twice, that is spelt out.
NEAR, FAR = 4, 6
ITEM = "array<struct<feature:string,u:double,c:double,labels:string>>"


def edge_feature(name: str):
    """Registers a function of a pair ``p`` that gives an array of ``item``."""
    return lambda f: EDGE.setdefault(name, f)


def root_feature(name: str):
    return lambda f: ROOT.setdefault(name, f)


def item(feature, u, c, labels: str | None = None) -> Column:
    lit = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(float(x))
    return F.struct((feature if isinstance(feature, Column) else F.lit(feature)).alias("feature"), lit(u).alias("u"), lit(c).alias("c"), F.lit(labels).cast("string").alias("labels"))


def text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Tags and paths ----------------------------------------------------------------------------------


def coarse_tags(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(t, "VB.*", "VB"), "NN.*", "NN"))


def coarser_tags(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "VB.*", "VB"), "NN.*|PRP|FW", "NN"), "JJ.*", "JJ"), "RB.*", "RB"))


def root_paths(heads: Column) -> Column:
    """For each word the places from the root down to it; empty where the way up is broken."""

    def climb(word):
        start = F.struct(word.cast("int").alias("at"), F.array().cast("array<int>").alias("path"))

        def up(z, _):
            on = z["at"] >= 0
            return F.struct(F.when(on, F.coalesce(F.get(heads, z["at"]), F.lit(-2))).otherwise(z["at"]).cast("int").alias("at"), F.when(on, F.array_prepend(z["path"], z["at"])).otherwise(z["path"]).alias("path"))

        return F.aggregate(heads, start, up, lambda z: F.when(z["at"] == -1, z["path"]).otherwise(F.array().cast("array<int>")))

    return F.transform(heads, lambda _, i: climb(i))


def common_prefix(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = F.array_position(same, F.lit(False))
    return F.when(end == 0, F.size(same)).otherwise(end - 1).cast("int")


def dependency_path(paths: Column, a: Column, b: Column) -> Column:
    """(up, down): from word a to the highest word of the way, and from there to word b; both hold the highest word."""
    pa, pb = F.get(paths, a), F.get(paths, b)
    from_ = F.greatest(common_prefix(pa, pb), F.lit(1))
    return F.struct(F.reverse(F.slice(pa, from_, F.size(pa))).alias("up"), F.slice(pb, from_, F.size(pb)).alias("down"))


def path_text(up: Column, down: Column, rels: Column, tags: Column) -> Column:
    """``POS_rel>_POS`` for each step up and ``POS_rel<_POS`` for each step down."""
    tag = lambda w: F.get(tags, w)
    steps = lambda way: F.slice(way, 1, F.greatest(F.size(way) - 1, F.lit(0)))
    ups = F.transform(steps(up), lambda w, i: text(tag(w), "_", F.get(rels, w), ">_", tag(F.get(up, i + 1))))
    downs = F.transform(steps(down), lambda w, i: text(tag(w), "_", F.get(rels, F.get(down, i + 1)), "<_", tag(F.get(down, i + 1))))
    return F.array_join(F.concat(ups, downs), "_")


def steps(heads: Column, rels: Column, tags: Column) -> tuple[Column, Column]:
    """For each word the step up to its head and the step down from there, as ``path_text`` spells them: a way follows heads, so
    that a sentence's pairs share the texts of its words."""
    own, head = lambda i: F.get(rels, i), lambda i: F.get(tags, F.get(heads, i))
    return F.transform(tags, lambda w, i: text(w, "_", own(i), ">_", head(i))), F.transform(tags, lambda w, i: text(head(i), "_", own(i), "<_", w))


def places(node: Column) -> Column:
    return F.sequence(node["start"], node["stop"] - 1)


def shortest(paths: Column, a: Column, b: Column) -> Column:
    """(size, w1, w2, up, down) of the shortest way between the words of two nodes; ties to the first words."""
    every = F.flatten(F.transform(places(a), lambda x: F.transform(places(b), lambda y: let(dependency_path(paths, x, y), lambda d: F.struct((F.size(d["up"]) + F.size(d["down"])).alias("size"), x.alias("w1"), y.alias("w2"), d["up"].alias("up"), d["down"].alias("down"))))))
    return F.array_min(every)


# Pairs -------------------------------------------------------------------------------------------


#: Shapes of sentences that a task remembers, and the most nodes whose ways are told by shape: both bound memory alone.
REMEMBERED, SMALL = 4096, 16
WAYS = "array<struct<i:int,j:int,size:int,w1:int,w2:int,up:array<int>,down:array<int>>>"


def ways_by_shape(heads: Column, nodes: Column) -> Column:
    """The shortest ways of all pairs of a sentence's nodes. They depend on its heads and the nodes' places alone, so that
    sentences of equal shape share them."""

    def told(heads, starts, stops):
        import pyarrow as pa

        places, indices, found = {}, [], []
        for shape in zip(*(map(lambda x: None if x is None else tuple(x), c.to_pylist()) for c in (heads, starts, stops))):
            if shape not in places:
                places[shape] = len(found)
                found.append(remembered(shape))
            indices.append(places[shape])
        return pa.array(found, WAYS_ARROW()).take(pa.array(indices, pa.int32()))

    at = lambda field: F.transform(nodes, lambda n: n[field].cast("int"))
    return F.arrow_udf(told, WAYS)(heads.cast("array<int>"), at("start"), at("stop"))


@lru_cache(REMEMBERED)
def remembered(shape) -> list[dict]:
    names = ("i", "j", "size", "w1", "w2", "up", "down")
    return [dict(zip(names, w)) for w in ways.shortest_ways(*shape)]


def WAYS_ARROW():
    import pyarrow as pa

    number, numbers = pa.int32(), pa.list_(pa.int32())
    return pa.list_(pa.struct([("i", number), ("j", number), ("size", number), ("w1", number), ("w2", number), ("up", numbers), ("down", numbers)]))


class Pair:
    """What a feature can ask of a pair: ``a`` is the tail, ``b`` the head; the rest are columns of the sentence, and what
    ``told`` has or makes by name (see ``DERIVED``)."""

    def __init__(self, told: Callable[[str], Column]):
        self.a, self.b, self.way, self.told = told("a"), told("b"), told("way"), told
        self.words, self.rels, self.raw, self.srl, self.heads = (F.col(f"__{x}") for x in ("words", "rels", "raw", "srl", "heads"))
        self.tags, self.v3, self.v2, self.v5 = (F.col(f"__{x}") for x in ("tags", "v3", "v2", "v5"))

    @property
    def distance(self) -> Column:
        return F.least(F.abs(self.a["start"] - self.b["stop"]), F.abs(self.a["stop"] - self.b["start"]))

    def spelt(self, kind: str) -> Column:
        """``path_text`` of the way, from the steps of its words under the tags of a kind (see ``steps``)."""
        ups, downs = F.col(f"__up{kind}"), F.col(f"__down{kind}")
        up, down = self.way["up"], self.way["down"]
        on = lambda way, first: F.slice(way, first, F.greatest(F.size(way) - 1, F.lit(0)))
        return F.array_join(F.concat(F.transform(on(up, 1), lambda w: F.get(ups, w)), F.transform(on(down, 2), lambda w: F.get(downs, w))), "_")

    @property
    def path3(self) -> Column:
        return self.told("path3")


@edge_feature("CostAugEdge")
def cost_handles(p):
    names = text("C1=", p.a["concept"], "+C2=", p.b["concept"])
    return F.when(p.a["span"] != p.b["span"], F.array(item(text("CA:U_", names), 1, 0), item(text("CA:", names), 0, 1))).otherwise(F.array().cast(ITEM))


@edge_feature("DDEdgeId")
def dual_handle(p):
    return F.array(item(text("DD:Id1=", p.a["id"]), 0, 1))


@edge_feature("LRLabelWithId")
def price_handle(p):
    return F.array(item(text("LR:Id1=", p.a["id"]), 0, 1))


@edge_feature("bias")
def bias(p):
    return F.array(item("Bias", 0, 1))


@edge_feature("biasScaled")
def bias_scaled(p):
    return F.array(item("Bias.01", 0.01, 0.01))


@edge_feature("edgeCount")
def edge_count(p):
    return F.array(item("Edge", 1, 0))


@edge_feature("biasCSuf")
def bias_suffix(p):
    return F.array(*(item(text(f"C{k}Suf3=", F.right(n["concept"], F.lit(3))), 1, 1) for k, n in ((1, p.a), (2, p.b))))


@edge_feature("typeBias")
def type_bias(p):
    kind = lambda n: F.when(n["concept"].rlike("^.*-[0-9][0-9]$"), "E").otherwise("O")
    found = [item(text(f"C{k}T=", kind(n)), 1, 1) for k, n in ((1, p.a), (2, p.b))]
    found += [item(text(f"C{k}T=", kind(n), f"LT={short}"), 0, 0, group) for group, short in (("ARG", "A"), ("other", "O")) for k, n in ((1, p.a), (2, p.b))]
    return F.array(*found)


@edge_feature("self")
def same_span(p):
    return F.array(item("Slf", F.when(p.a["span"] == p.b["span"], 1).otherwise(0), 0))


@edge_feature("fragHead")
def not_fragment_head(p):
    return F.array(*(item(f"C{k}NotFragHead", F.when(n["concept"] != n["frag_head"], 1).otherwise(0), 0) for k, n in ((1, p.a), (2, p.b))))


@edge_feature("distance")
def distance(p):
    name = text("d=", F.least(p.distance, F.lit(20)).cast("string"))
    return F.array(item(name, 1, 1), item(text(name, "+", p.path3), 1, 1))


@edge_feature("logDistance")
def log_distance(p):
    value = F.ln(p.distance + 1)
    return F.array(item("logD", value, value), item(text("logD+", p.path3), value, value))


@edge_feature("conceptBigram")
def concept_bigram(p):
    return F.array(item(text("C1=", p.a["concept"], "+C2=", p.b["concept"]), 0, 1))


@edge_feature("conceptUnigramWithLabel")
def concept_unigrams(p):
    return F.array(item(text("C1=", p.a["concept"]), 0, 1), item(text("C2=", p.b["concept"]), 0, 1))


@edge_feature("srl")
def semantic_roles(p):
    """An argument's words count if their syntactic head lies outside the argument."""
    inside = lambda w, lo, hi: (w >= lo) & (w < hi)

    def names(r):
        heads = F.greatest(F.least(p.a["stop"], r["p_stop"]) - F.greatest(p.a["start"], r["p_start"]), F.lit(0))
        deps = F.filter(places(p.b), lambda w: inside(w, r["a_start"], r["a_stop"]) & ~F.coalesce(inside(F.get(p.heads, w), r["a_start"], r["a_stop"]), F.lit(True)))
        one = F.array(item("SRL", 1, 1), item(text("SRL", r["pred"]), 1, 1), item(text("SRL=", r["arg"]), 1, 1), item(text("SRL", r["pred"], "=", r["arg"]), 1, 1))
        return F.flatten(F.array_repeat(one, heads * F.size(deps)))

    # Most pairs' first node has no word of a predicate: nothing more is asked there.
    return F.flatten(F.transform(F.filter(p.srl, lambda r: (r["p_start"] < p.a["stop"]) & (p.a["start"] < r["p_stop"])), names))


def span_tags(tags: Column, node: Column) -> Column:
    """The sorted distinct tags of a node's words, joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.slice(tags, node["start"] + 1, node["stop"] - node["start"]))), "_")


def tags_between(p) -> Column:
    after = p.b["start"] - p.a["stop"] >= 0
    start, stop = F.when(after, p.a["stop"]).otherwise(p.b["stop"]), F.when(after, p.b["start"]).otherwise(p.a["start"])
    return F.slice(p.tags, start + 1, F.greatest(stop - start, F.lit(0)))


def tag_context(p) -> Column:
    return text("C1PS=", p.a["tags"], "+C2PS=", p.b["tags"], "+dir=", F.when(p.a["start"] < p.b["start"], "+1").otherwise("-1"), "+")


def tag_counts(between: Column) -> Column:
    """(gram, n): ``U=X`` and ``B=X_Y`` with how often they occur; a single tag makes the pair X_NONE."""
    pairs = F.when(F.size(between) == 1, F.array(text(F.get(between, F.lit(0)), "_NONE"))).otherwise(F.transform(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), lambda t, i: text(t, "_", F.get(between, i + 1))))
    count = lambda kind, grams: F.transform(F.array_distinct(grams), lambda g: F.struct(text(kind, g).alias("gram"), F.size(F.filter(grams, lambda x: x == g)).alias("n")))
    return F.concat(count("U=", between), count("B=", pairs))


@edge_feature("posPathv1")
def tag_path1(p):
    context, path = text(p.told("context"), "PPv1"), text(p.path3, "+")

    def names(g):
        one = lambda name, n: F.array(item(name, g["n"], g["n"]), item(text(name, "_", n), 1, 1), item(text(path, name), g["n"], g["n"]), item(text(path, name, "_", n), 1, 1))
        return let(F.struct(text(context, g["gram"]).alias("name"), g["n"].cast("string").alias("n")), lambda x: one(x["name"], x["n"]))

    return F.flatten(F.transform(p.told("grams"), names))


@edge_feature("posPathv2")
def tag_path2(p):
    return F.transform(p.told("grams"), lambda g: item(text(p.told("context"), "PPv2", g["gram"], "_", g["n"].cast("string")), 1, 1))


@edge_feature("posPathv3")
def tag_path3(p):
    between = p.told("between")
    whole = text(p.told("context"), "PPv3.1=", F.array_join(between, "_"))
    distinct = text(p.told("context"), "PPv3.2=", F.array_join(F.array_distinct(between), "_"))
    return F.array(item(whole, 1, 1), item(text(whole, p.path3), 1, 1), item(distinct, 1, 1), item(text(distinct, p.path3), 1, 1))


def word_parts(p) -> list[Column]:
    """C1=, C2=, W1=, W2= of the concepts and of the words between which the way is the shortest."""
    return [text("C1=", p.a["concept"]), text("C2=", p.b["concept"]), text("W1=", F.get(p.words, p.way["w1"])), text("W2=", F.get(p.words, p.way["w2"]))]


@edge_feature("dependencyPathv2")
def path2(p):
    way = text("DPv2=", p.told("spelt2"))
    c1, c2, w1, w2 = word_parts(p)
    found = F.array(*(item(text(x, "+", way), 0, 1) for x in (text(c1, "+", c2), text(w1, "+", w2), w1, w2)), item(way, 0, 1))
    return F.when(p.way["size"] <= NEAR, found).otherwise(F.array().cast(ITEM))


@edge_feature("dependencyPathv3")
def path3(p):
    way = text("DPv3=", p.told("spelt3"))
    found = F.array(*(item(text(x, "+", way), 1, 0) for x in word_parts(p)), item(way, 1, 1))
    return F.when(p.way["size"] <= NEAR, found).otherwise(F.array(item("DPv3=NONE", 1, 0)))


def path_far(p, name: str, spelt: Column) -> Column:
    way = text(name, spelt)
    found = F.array(*(item(text(x, "+", way), 1, 1) for x in word_parts(p)), item(way, 1, 1))
    return F.when(p.way["size"] <= FAR, found).otherwise(F.array(item(f"{name}NONE", 1, 1)))


@edge_feature("dependencyPathv4")
def path4(p):
    return path_far(p, "DPv4=", p.told("spelt3"))


@edge_feature("dependencyPathv5")
def path5(p):
    """As v4, with prepositions as words."""
    return path_far(p, "DPv5=", p.told("spelt5"))


@root_feature("rootConcept")
def root_concept(node, _):
    return F.array(item(text("C=", node["concept"], "+L=<ROOT>"), 1, 0))


@root_feature("rootCostAug")
def root_cost_handle(node, _):
    return F.array(item(text("CA:C1=", node["concept"], "+L=<ROOT>"), 1, 0))


@root_feature("rootDependencyPathv1")
def root_path(node, row):
    ways = F.transform(places(node), lambda w: F.struct(F.size(F.get(row["paths"], w)).alias("size"), w.alias("w"), F.get(row["paths"], w).alias("way")))
    spelt = path_text(F.array().cast("array<int>"), F.array_min(ways)["way"], row["rels"], row["tags"])
    return F.array(item(text("DPRv1=", spelt, "+L=<ROOT>"), 1, 0))


def prepared(sentences: DataFrame, names, *more: str) -> DataFrame:
    """The columns that features share, and ``more``. Tags are made alike from the start if any named feature does so."""
    tags = F.col("pos")
    tags = coarser_tags(tags) if "dependencyPathv2" in names else tags
    tags = coarse_tags(tags) if COARSE & set(names) else tags
    out = sentences.select("sent_id", *more, F.col("words").alias("__words"), F.col("rels").alias("__rels"), F.col("heads").alias("__heads"), F.col("srl").alias("__srl"), F.col("pos").alias("__raw"), F.filter("nodes", lambda n: n["start"] < n["stop"]).alias("__nodes"), tags.alias("__tags"))
    out = out.withColumns({"__paths": root_paths(F.col("__heads")), "__v3": coarse_tags(F.col("__tags")), "__v2": coarser_tags(F.col("__raw"))})
    out = out.withColumn("__v5", F.transform("__v3", lambda t, i: F.when(t == "IN", F.lower(F.get("__words", i))).otherwise(t)))
    if "context" in asked(n for n in names if n in EDGE):
        out = out.withColumn("__nodes", F.transform("__nodes", lambda n: n.withField("tags", span_tags(F.col("__tags"), n))))
    spelt = {k: steps(F.col("__heads"), F.col("__rels"), F.col(f"__v{k}")) for k in KINDS}
    return out.withColumns({f"__{way}{k}": c for k, both in spelt.items() for way, c in zip(("up", "down"), both)})


def known(names, table: dict) -> list[str]:
    unknown = sorted(set(names) - set(EDGE) - set(ROOT))
    if unknown:
        raise ValueError(f"unknown stage-2 features: {unknown}")
    return [n for n in names if n in table]


#: What several features ask of a pair, made once a pair; later ones see what those before them have.
DERIVED: dict[str, Callable[[Pair], Column]] = {
    "spelt2": lambda p: F.when(p.way["size"] <= NEAR, p.spelt("2")),
    "spelt3": lambda p: F.when(p.way["size"] <= FAR, p.spelt("3")),
    "spelt5": lambda p: F.when(p.way["size"] <= FAR, p.spelt("5")),
    "between": tags_between,
    "context": tag_context,
    "path3": lambda p: text("DPv3=", F.when(p.way["size"] <= NEAR, p.told("spelt3")).otherwise("NONE")),
    "grams": lambda p: tag_counts(p.told("between")),
}


def asked(chosen) -> list[str]:
    """What of ``DERIVED`` the named features ask for."""
    names: set[str] = set()
    note = lambda name: names.add(name) or F.col(name)
    for n in chosen:
        EDGE[n](Pair(note))
    for name in reversed(DERIVED):
        if name in names:
            DERIVED[name](Pair(note))
    return [n for n in DERIVED if n in names]


def of_pair(a: Column, b: Column, chosen) -> Column:
    """The items of the named features of one pair."""
    way = F.lit(None).cast(WAY) if set(chosen) <= PATHLESS else shortest(F.col("__paths"), a, b)

    def made(p, had, names):
        if not names:
            return F.concat(F.array().cast(ITEM), *(EDGE[n](Pair(lambda x: p[x])) for n in chosen))
        more = F.struct(*(p[x].alias(x) for x in had), DERIVED[names[0]](Pair(lambda x: p[x])).alias(names[0]))
        return let(more, lambda q: made(q, [*had, names[0]], names[1:]))

    return let(F.struct(a.alias("a"), b.alias("b"), way.alias("way")), lambda p: made(p, ["a", "b", "way"], asked(chosen)))


def with_pairs(sentences: DataFrame, names, *more: str) -> tuple[DataFrame, Column, list[str]]:
    """The prepared sentences, and ``more`` of them; the array of their ordered pairs of different nodes; the named features."""
    chosen, rows = known(names, EDGE), prepared(sentences, names, *more)
    nodes, other = F.col("__nodes"), lambda a: F.filter("__nodes", lambda b: b["id"] != a["id"])
    pair = lambda a, b, way: F.struct(a.alias("a"), b.alias("b"), way.alias("way"))
    each = lambda way: F.flatten(F.transform(nodes, lambda a: F.transform(other(a), lambda b: pair(a, b, way(a, b)))))
    if set(chosen) <= PATHLESS:
        return rows, each(lambda a, b: F.lit(None).cast(WAY)), chosen
    small = F.size(nodes) <= SMALL
    rows = rows.withColumn("__ways", ways_by_shape(F.col("__heads"), F.when(small, nodes).otherwise(F.slice(nodes, 1, 0))))
    way = lambda w: F.struct(*(w[x].alias(x) for x in ("size", "w1", "w2", "up", "down")))
    near = F.filter(F.transform("__ways", lambda w: pair(F.get(nodes, w["i"]), F.get(nodes, w["j"]), way(w))), lambda p: p["a"]["id"] != p["b"]["id"])
    return rows, F.when(small, near).otherwise(each(lambda a, b: shortest(F.col("__paths"), a, b))), chosen


#: The columns of a sentence that its pairs' features look at.
SHARED = tuple(f"__{x}" for x in ("words", "rels", "heads", "srl", "raw", "tags", "v3", "v2", "v5", *(f"{way}{k}" for way in ("up", "down") for k in KINDS)))


def derived(rows: DataFrame, chosen) -> DataFrame:
    """Pair rows with what the named features ask for."""
    for name in asked(chosen):
        rows = rows.withColumn(name, DERIVED[name](Pair(F.col)))
    return rows


def items_of(chosen) -> Column:
    return F.concat(F.array().cast(ITEM), *(EDGE[n](Pair(F.col)) for n in chosen))


def edge_features(sentences: DataFrame, names) -> DataFrame:
    """(sent_id, src, dst, feature, u, c, labels) of every ordered pair of different nodes for the named features."""
    rows, pairs, chosen = with_pairs(sentences, names)
    rows = derived(rows.select("sent_id", *SHARED, F.inline(pairs)), chosen)
    return rows.select("sent_id", F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.inline(items_of(chosen)))


class Probe(Pair):
    """A pair that notes what is asked of it."""

    def __init__(self):
        self.seen: set[str] = set()
        self.told = lambda name: self.seen.add(name) or F.col(name)


for _name in ("a", "b", "way", "words", "rels", "raw", "srl", "heads", "tags", "v3", "v2", "v5"):
    setattr(Probe, _name, property(lambda self, name=_name: self.told(name)))


def looked_at(*makers: Callable[[Pair], Column]) -> set[str]:
    """What functions of a pair look at themselves, not by way of what they ask for by name."""
    probe = Probe()
    for make in makers:
        make(probe)
    return probe.seen


def alike(chosen) -> list[str]:
    """The columns of ``DERIVED`` that tell all of a pair that the named features look at; none if they look at more."""
    seen = looked_at(*(EDGE[n] for n in chosen))
    if not seen or not seen <= set(DERIVED):
        return []
    inputs = {n: looked_at(DERIVED[n]) for n in seen}
    return sorted(seen - {n for n, own in inputs.items() if own <= seen - {n}})


def feature_totals(sentences: DataFrame, names) -> DataFrame:
    """(feature, labels, n, u, c): each feature's occurrences over all ordered pairs of different nodes, and its values added up.

    Pairs that are alike in all that the features look at are counted first, and have their features made once.
    """
    rows, pairs, chosen = with_pairs(sentences, names)
    rows, keys = derived(rows.select(*SHARED, F.inline(pairs)), chosen), alike(chosen)
    if keys:
        rows = rows.groupBy(*keys).agg(F.count("*").alias("times"))
        for name in (x for x in asked(chosen) if x not in keys and looked_at(DERIVED[x]) <= set(keys)):
            rows = rows.withColumn(name, DERIVED[name](Pair(F.col)))
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    f = rows.select("times", F.inline(items_of(chosen)))
    return f.groupBy("feature", "labels").agg(F.sum("times").alias("n"), F.sum(F.col("u") * F.col("times")).alias("u"), F.sum(F.col("c") * F.col("times")).alias("c"))


def pair_items(sentences: DataFrame, edge_names, root_names) -> DataFrame:
    """(first, given, roots, src, dst, items): a row for each pair with its features as an array, none of them dealt out.

    A sentence's rows stand together. The first of them, which a sentence without pairs has as well, has ``given``, a column of
    ``sentences``, and ``roots``, an array of the features of its nodes as roots.
    """
    rows, pairs, chosen = with_pairs(sentences, edge_names, "given")
    rows = rows.withColumn("roots", root_items(known(root_names, ROOT), {"paths": F.col("__paths"), "rels": F.col("__rels"), "tags": F.col("__raw")}))
    rows = rows.select("given", "roots", *SHARED, F.posexplode_outer(pairs).alias("at", "pair"))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    rows = derived(rows.select(first.alias("first"), "given", "roots", *SHARED, "pair.a", "pair.b", "pair.way"), chosen)
    on_first = lambda c: F.when(F.col("first"), F.col(c)).alias(c)
    return rows.select("first", on_first("given"), on_first("roots"), F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.when(F.col("a").isNotNull(), items_of(chosen)).alias("items"))


def graph_vector(sentences: DataFrame, edge_names, root_names, group: Callable[[Column], Column]) -> DataFrame:
    """(sent_id, feature, label, value) of each sentence's own ``edges`` (array of src, label, dst) and ``root``.

    Only those pairs have their features made, beside the words: no table of all pairs' features is made or joined. An
    edge has a feature's unconjoined value (null label), once more if its label is of the feature's ``group``, and the
    conjoined value under its label; an edge to a node without words, or to itself, has none.
    """
    edges, roots = known(edge_names, EDGE), known(root_names, ROOT)
    rows = prepared(sentences, [*edge_names, *root_names], "edges", "root")
    row = {"paths": F.col("__paths"), "rels": F.col("__rels"), "tags": F.col("__tags")}
    entry = lambda feature, label, value: F.struct(feature.alias("feature"), label.cast("string").alias("label"), value.cast("double").alias("value"))
    named = lambda id: F.filter("__nodes", lambda n: n["id"] == id)

    def of_edge(e):
        def items(a, b):
            both = lambda f: F.array(entry(f["feature"], F.lit(None), f["u"] + F.when(f["labels"] == group(e["label"]), 1.0).otherwise(0.0)), entry(f["feature"], e["label"], f["c"]))
            return F.flatten(F.transform(of_pair(a, b, edges), both))

        return F.flatten(F.transform(named(e["src"]), lambda a: F.flatten(F.transform(F.filter(named(e["dst"]), lambda b: b["id"] != a["id"]), lambda b: items(a, b)))))

    found = F.flatten(F.transform("edges", of_edge))
    top = F.flatten(F.transform(named(F.col("root")), lambda n: F.transform(F.concat(F.array().cast(ITEM), *(ROOT[x](n, row) for x in roots)), lambda f: entry(f["feature"], F.lit(None), f["u"]))))
    # Root features count with any value, as edges' do unless it is zero.
    return rows.select("sent_id", F.inline(F.concat(F.filter(found, lambda v: v["value"] != 0), top)))


def root_items(chosen, row: dict[str, Column]) -> Column:
    """An array of (node_id, feature, u): the features of each node as a root."""
    of = lambda n: F.transform(F.concat(F.array().cast(ITEM), *(ROOT[x](n, row) for x in chosen)), lambda f: F.struct(n["id"].alias("node_id"), f["feature"].alias("feature"), f["u"].alias("u")))
    return F.flatten(F.transform("__nodes", of))


def root_features(sentences: DataFrame, names) -> DataFrame:
    """(sent_id, node_id, feature, u) of every node as a root."""
    chosen, rows = known(names, ROOT), prepared(sentences, names)
    row = {"paths": F.col("__paths"), "rels": F.col("__rels"), "tags": F.col("__tags")}
    return rows.select("sent_id", F.inline(root_items(chosen, row)))
