"""Near copies by exact Jaccard similarity of word shingles: Golay links and a prefix-filtered set join.

Two sets of a similarity of 4/5 or more share a shingle among the first n - ceil(4n/5) + 1 of each, whatever the
order of all shingles is. The order here puts shingles that are common in a sample last, which bears on cost
only. Fingerprints at four bits or less and the first member of each bucket give the links of a first round;
texts that are not connected by it and share a bucket are the second. All links are checked on the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.llm.common import cut, few, let_go

#: Share of the texts, by hash, from which the order of shingles is taken, and how many common shingles are put last.
#: A share, since a shingle that is in a fixed sample twice is in ever more texts as the table grows.
ORDER_SHARE = 0.1
COMMON = 100_000
#: Up to so many texts to be compared are picked by a broadcast of their hashes; more are dealt out.
PICKED = 500_000
#: Pairs of a part in which they are compared on the texts, and the least side of the grid of parts.
PART_PAIRS, LEAST_SIDE = 10_000, 8
#: Cells of a text's sketch, a power of two.
CELLS = 128
#: Buckets up to this size are compared many at a time.
TOGETHER = 64


class Hashes(dict):
    """Hash of each word, remembered; emptied when it is full, which changes no result."""

    LARGEST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LARGEST:
            self.clear()
        return self.setdefault(word, xxhash.xxh64_intdigest(word, simhash.SEED))


HASHES = Hashes()


def forget() -> None:
    HASHES.clear()


#: Odd numbers by which the words of a window are weighted, by place.
WEIGHTS = np.array([xxhash.xxh64_intdigest(b"place", k) | 1 for k in range(64)], dtype=np.uint64)


def gram_hashes(text: str | None, size: int) -> np.ndarray:
    """A hash of each window of ``size`` words, in order; a shorter text is one window, one without words none."""
    words = simhash.words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += (own[k : k + n] ^ (own[k : k + n] >> np.uint64(29))) * WEIGHTS[k]
    # Mixed, so that every bit depends on all words.
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words; a shorter text is one window, one without words none."""
    return np.unique(gram_hashes(text, size))


def sketch(own: np.ndarray) -> bytes | None:
    """How many of a text's shingles fall into each of ``CELLS`` cells by their hash; none if a cell has more than a byte holds."""
    counts = np.bincount((own >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64), minlength=CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def reachable(batches):
    """Pairs whose sketches leave room for a similarity of 0.8: two sets share no more than the lesser count of each cell."""
    for batch in batches:
        n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
        a, b = (batch.column(x) for x in ("sketch_a", "sketch_b"))
        known = np.flatnonzero(np.asarray(a.is_valid()) & np.asarray(b.is_valid()))
        keep = np.ones(len(n), bool)
        if len(known):
            at = pa.array(known)
            x, y = (np.frombuffer(b"".join(c.take(at).to_pylist()), np.uint8).reshape(-1, CELLS) for c in (a, b))
            keep[known] = 9 * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= 4 * n[known]
        yield batch.select(["a", "b", "of_a", "of_b"]).filter(pa.array(keep))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    both = np.sort(np.concatenate([a, b]))
    return 9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * (len(a) + len(b))


def prefix(own: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 of a text's shingles: rare ones by hash, then common ones by how often they are."""
    n = len(own) - (4 * len(own) + 4) // 5 + 1
    if not len(common):
        return own[:n]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    often = common[at] == own
    rare = own[~often]
    if len(rare) >= n:
        return rare[:n]
    rest, counts = own[often], times[at[often]]
    return np.concatenate([rare, rest[np.lexsort((rest, counts))][: n - len(rare)]])


def common_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    some = rows.where(F.pmod("of", F.lit(1_000_000)) < int(ORDER_SHARE * 1_000_000)).dropDuplicates(["of"]).select("text")

    def run(batches):
        for batch in batches:
            found = [shingles(t, shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], names=["gram"])

    seen = some.mapInArrow(run, "gram long").groupBy("gram").count().where("count > 2")
    top = seen.orderBy(F.desc("count"), "gram").limit(COMMON).toArrow()
    grams, times = top.column("gram").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(grams)
    return grams[order], times[order]


def runs(batches, names):
    """Rows of sorted batches, as numpy columns of whole buckets (equal values of the first column)."""
    left = None
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        left = columns if left is None else [np.concatenate(x) for x in zip(left, columns)]
        if len(left[0]):
            last = np.searchsorted(left[0], left[0][-1])
            if last:
                yield [x[:last] for x in left]
                left = [x[last:] for x in left]
    if left is not None and len(left[0]):
        yield left


def bounds(keys: np.ndarray):
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)]


def may_fit(n, at, m, of):
    """Whether sets of n and m shingles that meet at these places of their prefixes may be similar, by that alone."""
    both = np.minimum(n - at, m - of)
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * both >= 4 * (n + m))


def shared(batches):
    """Rows of buckets of two or more; ``first`` is the bucket's first text if it may be similar."""
    for key, sid, n, at in runs(batches, ("key", "sid", "n", "at")):
        starts, ends = bounds(key)
        size = ends - starts
        many = np.repeat(size > 1, size)
        n, at = n.astype(np.int64), at.astype(np.int64)
        fit = may_fit(n, at, np.repeat(n[starts], size), np.repeat(at[starts], size))
        first = pa.array(np.repeat(sid[starts], size)[many], mask=~fit[many])
        yield pa.RecordBatch.from_arrays([*(pa.array(x[many]) for x in (key, sid, n.astype(np.int32), at.astype(np.int32))), first], names=["key", "sid", "n", "at", "first"])


def apart(batches):
    """Pairs of a bucket that are not connected yet and may be similar by their sizes and the key's places."""

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for key, sid, n, at, label in runs(batches, ("key", "sid", "n", "at", "label")):
        n, at = n.astype(np.int64), at.astype(np.int64)
        starts, ends = bounds(key)
        mixed = np.logical_or.reduceat(label != np.repeat(label[starts], ends - starts), starts)
        small = mixed & (ends - starts <= TOGETHER)
        rows = np.flatnonzero(np.repeat(small, ends - starts))
        last = np.repeat(ends, ends - starts)[rows]
        for step in range(1, TOGETHER):
            rows, last = rows[rows + step < last], last[rows + step < last]
            if not len(rows):
                break
            fit = (label[rows] != label[rows + step]) & may_fit(n[rows], at[rows], n[rows + step], at[rows + step])
            if fit.any():
                yield out(sid[rows[fit]], sid[rows[fit] + step])
        for s, e in zip(starts[mixed & ~small].tolist(), ends[mixed & ~small].tolist()):
            _, of, count = np.unique(label[s:e], return_inverse=True, return_counts=True)
            m, p, ids = n[s:e], at[s:e], sid[s:e]
            # Pairs of the greatest group with itself are connected; all others have a member outside it.
            outside = of != count.argmax()
            for i in np.flatnonzero(outside).tolist():
                fit = (of != of[i]) & may_fit(m, p, m[i], p[i]) & (~outside | (ids > ids[i]))
                if fit.any():
                    yield out(ids[fit], np.full(fit.sum(), ids[i]))


def near_copies(df: DataFrame, *, key: Column, text: str = "text", shingle: int = 5) -> DataFrame:
    """(key, component_id) of every row: the least key that links of a Jaccard similarity of 0.8 or more lead to.

    Texts without words are copies of one another. Null texts are empty; a null key is linked like any other.
    """
    rows = df.select(key.alias("key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("of"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, shingle))
    kind = rows.schema["key"].dataType.simpleString()

    def measure(batches):
        let_go("nearcopies")
        for batch in batches:
            made = []
            for t in batch.column(2).to_pylist():
                grams = gram_hashes(t, shingle)
                own = np.unique(grams)
                fp = simhash.majority(simhash.ones_of(grams), len(grams)) if len(grams) else 0
                made.append((xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), fp, len(own), prefix(own, *order.value).view(np.int64), sketch(own)))
            sid, fp, n, keys, cells = zip(*made) if made else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sid, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(cells, pa.binary())], names=["key", "of", "sid", "fp", "n", "keys", "sketch"])

    prints = cut(rows.mapInArrow(measure, f"key {kind}, of long, sid long, fp long, n int, keys array<long>, sketch binary"))
    sets = cut(prints.groupBy("sid").agg(F.min("key").alias("least"), F.min("of").alias("of"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("keys").alias("keys"), F.min("sketch").alias("sketch")))

    spread = sets.where("n > 0").select("sid", "n", F.posexplode("keys").alias("at", "key")).select("key", "sid", "n", "at")
    spread = spread.repartition("key").sortWithinPartitions("key", "sid")
    buckets = cut(spread.mapInArrow(shared, "key long, sid long, n int, at int, first long"))
    heads = cut(sets.groupBy("fp").agg(F.min("sid").alias("head")))
    close = simhash.candidate_links(heads).join(heads.toDF("a", "ha"), "a").join(heads.toDF("b", "hb"), "b").select("ha", "hb")
    same = sets.join(heads, "fp").select("head", "sid")
    near = buckets.where("first is not null").select("first", "sid").union(close).union(same).toDF("a", "b").where("a != b")
    links = verified(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, rows, shingle)

    labels = simhash.components(links)
    with_labels = buckets.join(labels, buckets.sid == labels.node, "left").select("key", "sid", "n", "at", F.coalesce("label", "sid").alias("label"))
    rest = with_labels.repartition("key").sortWithinPartitions("key").mapInArrow(apart, "a long, b long").distinct()
    more = verified(rest, sets, rows, shingle)

    of = simhash.components(links.union(more))
    named = sets.select("sid", "least").join(of, F.col("sid") == of.node, "left").select("sid", "least", F.coalesce("label", "sid").alias("label"))
    # Joined on another form of the label, so that both sides are dealt anew and a hot one can be split.
    least = named.groupBy("label").agg(F.min("least").alias("component_id")).select(F.bitwise_not("label").alias("k"), "component_id")
    classes = cut(named.withColumn("k", F.bitwise_not("label")).join(least, "k").select("sid", "component_id"))
    left = prints.select("key", F.bitwise_not("sid").alias("k"))
    return left.join(classes.select("component_id", F.bitwise_not("sid").alias("k")), "k").select("key", "component_id")


def verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` whose texts have a Jaccard similarity of 0.8 or more.

    Sizes and sketches come first: they rule out most pairs that are not similar before any text is sent.
    """
    ids = sets.select("sid", "of", "n", "sketch")
    a, b = ids.toDF("a", "of_a", "n_a", "sketch_a"), ids.toDF("b", "of_b", "n_b", "sketch_b")
    fit = F.expr("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    pairs = cut(pairs.join(a, "a").join(b, "b").where(fit).mapInArrow(reachable, "a long, b long, of_a long, of_b long"))
    n = pairs.count()  # one number
    # A grid of parts: a text goes to the parts of its row or column that have pairs with it, once each, not once for each pair.
    side = max(LEAST_SIDE, math.ceil(math.sqrt(n / PART_PAIRS)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    pairs = pairs.select("a", "b", "of_a", "of_b", (place("of_a") * side + place("of_b")).cast("int").alias("part"))
    needed = cut(pairs.select("part", F.col("of_a").alias("of")).union(pairs.select("part", F.col("of_b"))).distinct().coalesce(few(n)))
    wanted = needed.select("of").distinct()
    picked = F.broadcast(wanted) if 2 * n <= PICKED else wanted
    texts = rows.select("of", "text").join(picked, "of", "left_semi").dropDuplicates(["of"])
    none = F.lit(None).cast("long")
    sent = needed.join(texts, "of").select("part", F.lit(0).alias("kind"), "of", "text", none.alias("a"), none.alias("b"), none.alias("of_b"))
    asked = pairs.select("part", F.lit(1).alias("kind"), F.col("of_a").alias("of"), F.lit(None).cast("string").alias("text"), "a", "b", "of_b")

    def run(batches):
        let_go("nearcopies")
        here, held = None, {}
        for batch in batches:
            part, kind, of, text, a, b, of_b = (c.to_pylist() for c in batch.columns)
            kept: list[int] = []
            for i in range(len(part)):
                if part[i] != here:
                    here, held = part[i], {}
                if kind[i] == 0:
                    held[of[i]] = shingles(text[i], shingle)
                elif similar(held[of[i]], held[of_b[i]]):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], pa.int64()) for x in (a, b)], names=["a", "b"])

    met = sent.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")
    return cut(met.mapInArrow(run, "a long, b long").coalesce(few(n)))
