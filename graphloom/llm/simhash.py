"""SimHash near-duplicates by Golay-code fuzzy hashing.

The perfect binary Golay code (23, 12, 7) puts every 23-bit word within distance three of one codeword. A
word's keys are the indices of all codewords within distance four: one key if the nearest codeword is
at distance two or less, six if it is at three. Two words at distance two or less always share a key.
A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in four bits
at most, then either some segment is equal and another differs in two bits at most, or two segments
differ in one bit each (so that one half of each is equal) and the third in two at most. Keys for all
these cases meet in a bucket; fingerprints of a bucket are compared exactly.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, few, without

SEED = 42
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LINK_BITS = 4
LANES = np.uint64(0x0101010101010101)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 after A-Z are lower-cased: what bytes are split and lower-cased by."""
    return (text or "").encode("utf-8", "replace").lower().split()


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The majority bits of the shingles' hashes, as a signed 64-bit number; zero if there is no word."""
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_280):
        some = words[at : min(n, at + 65_280) + shingle - 1]
        whole, sizes = b" ".join(some), np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1
        starts = sizes.cumsum() - sizes
        last = min(shingle, len(some)) - 1
        ends = (starts + sizes - 1)[last:]
        grams = map(whole.__getitem__, map(slice, starts[: len(ends)].tolist(), ends.tolist()))
        ones += ones_of(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(ends)))
    return majority(ones, n)


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each of the 64 bits."""
    ones = np.zeros(64, dtype=np.int64)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & LANES
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))
        ones[bit::8] += sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    bits = np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, keep=None) -> DataFrame:
    """``df`` with ``fp``, the SimHash of the whole text. Null or empty texts have the fingerprint zero."""
    kept = [c for c in without(df, ("fp",)) if keep is None or c in keep]
    source = df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text}`"].cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "fp long"])

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*batch.schema.names[:-1], "fp"])

    return source.mapInArrow(run, schema)


@lru_cache(1)
def syndromes() -> np.ndarray:
    """Division remainders of all 23-bit words whose lower or upper 12 bits only are set."""
    low = np.arange(1 << 12, dtype=np.int64)
    out = []
    for shift in (0, 12):
        r = (low << shift) & ((1 << 23) - 1)
        for bit in range(22, 10, -1):
            r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
        out.append(r)
    return np.array(out)


def remainder(words: np.ndarray) -> np.ndarray:
    low, high = syndromes()
    return low[words & 0xFFF] ^ high[words >> 12]


@lru_cache(1)
def errors() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder: the error patterns of weight four or less that have it (1 or 6), and how many."""
    table, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    patterns = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(23), w)], dtype=np.int64)
    light = np.array([int(p).bit_count() for p in patterns])
    of = remainder(patterns)
    for weights in ((0, 1, 2, 3), (4,)):
        for p, r in zip(patterns[np.isin(light, weights)].tolist(), of[np.isin(light, weights)].tolist()):
            if weights == (4,) and int(table[r, 0]).bit_count() < 3:
                continue
            table[r, count[r]] = p
            count[r] += 1
    return table, count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within distance four of 23-bit words, and how many there are."""
    table, count = errors()
    r = remainder(words)
    return (words[:, None] ^ table[r]) >> 11, count[r]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions in ``fps``): fingerprints at four bits or less share a key."""
    bits = fps.view(np.uint64)
    segment = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = [golay_keys(s) for s in segment]
    keys, at = [], []

    def add(case: int, exact: np.ndarray, third: int) -> None:
        index, count = near[third]
        for k in range(6):
            rows = np.flatnonzero(count > k)
            keys.append((exact[rows] << 12 | index[rows, k]) << 6 | case)
            at.append(rows)

    for case, (i, j) in enumerate(permutations(range(3), 2)):
        add(case, segment[i], j)
    case = 6
    for third in range(3):
        i, j = (x for x in range(3) if x != third)
        for a, b in product(range(2), repeat=2):
            add(case, half(segment[i], i, a) << 11 | half(segment[j], j, b), third)
            case += 1
    return np.concatenate(keys), np.concatenate(at)


def half(segment: np.ndarray, i: int, upper: int) -> np.ndarray:
    return segment >> 11 if upper else segment & 0x7FF


def links_in(members: np.ndarray, bits: int = LINK_BITS) -> list[tuple[int, int]]:
    """Links that connect what is connected among distinct fingerprints: one for each but the first of a group.

    A search by nearness: each fingerprint reached is compared with those not reached yet, so a group of
    copies costs a comparison or two for each member and gives no pair twice.
    """
    links: list[tuple[int, int]] = []
    rest = np.sort(members).view(np.uint64)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            close = np.bitwise_count(rest ^ front.pop()) <= bits
            found = rest[close]
            if len(found):
                links += zip(repeat(root.astype(np.int64)), found.view(np.int64))
                front += list(found)
                rest = rest[~close]
    return links


def candidate_links(reps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints; their connected components are those of all links."""

    def expand(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start in range(0, len(fps), 8192):
                some = fps[start : start + 8192]
                keys, at = bucket_keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[at])], names=["key", "fp"])

    def join(batches):
        left = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            keys = np.concatenate([left[0], batch.column(0).to_numpy()])
            fps = np.concatenate([left[1], batch.column(1).to_numpy()])
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            left = (keys[last:], fps[last:])
            yield from found_in(keys[:last], fps[:last])
        yield from found_in(*left)

    def found_in(keys, fps):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(keys)]
        links: set[tuple[int, int]] = set()
        many = ends - starts > 1
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            if e - s == 2:
                if np.bitwise_count(fps[s].view(np.uint64) ^ fps[s + 1].view(np.uint64)) <= LINK_BITS:
                    links.add((fps[s], fps[s + 1]))
            else:
                links.update(links_in(fps[s:e]))
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

    keys = reps.select("fp").mapInArrow(expand, "key long, fp long")
    buckets = keys.repartition("key").sortWithinPartitions("key")
    return buckets.mapInArrow(join, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for nodes with links.

    Least labels of neighbours, then the label of the label, until nothing changes. Each round is written
    to the shared folder; only the number of changed labels comes to the driver.
    """
    links = cut(links.select("a", "b"))
    parts = few(2 * links.count())  # one number
    both = links.union(links.select("b", "a")).toDF("v", "u").coalesce(parts)
    labels = cut(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")).coalesce(parts))
    while True:
        seen = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("m"))
        new = labels.join(seen, "v").select("v", F.col("label").alias("was"), F.least("label", "m").alias("now"))
        onward = labels.select(F.col("v").alias("now"), F.col("label").alias("next"))
        new = cut(new.join(onward, "now", "left").select("v", "was", F.least("now", "next").alias("label")).coalesce(parts))
        if new.where("was != label").limit(1).count() == 0:
            return new.select(F.col("v").alias("node"), "label")
        labels = new.select("v", "label")


def near_duplicates(df: DataFrame, *, key: Column | None = None, text: str = "text", shingle: int = 4) -> DataFrame:
    """One row per row of ``df``: its key, ``fp`` and ``component_id``, the least key that links lead to.

    ``key`` is ``doc_id`` unless given. Texts without words have the fingerprint zero and are linked like any
    other. Nulls in other columns do not matter; rows with a null key are linked like the rest, and their component is
    the least key in it that is not null (null if there is none). Repeated rows and exact copies share a
    fingerprint and so a component. An empty table gives no rows.
    """
    key = F.col("doc_id") if key is None else key
    rows = df.select(key.alias("key"), F.col(f"`{text}`").alias("text"))
    prints = cut(fingerprints(rows, "text", shingle, keep=("key",)))
    reps = cut(prints.groupBy("fp").agg(F.min("key").alias("least")))
    of = components(candidate_links(reps))
    named = reps.join(of, reps.fp == of.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # Joined on another form of the label or fingerprint, so that both sides are dealt anew and a hot one can be split.
    least = named.groupBy("label").agg(F.min("least").alias("component_id")).select(F.bitwise_not("label").alias("k"), "component_id")
    classes = cut(named.withColumn("k", F.bitwise_not("label")).join(least, "k").select("fp", "component_id"))
    left = prints.select("key", "fp", F.bitwise_not("fp").alias("k"))
    return left.join(classes.select("component_id", F.bitwise_not("fp").alias("k")), "k").select("key", "fp", "component_id")
