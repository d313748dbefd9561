"""Collocations: phrases of two to five words that stand together more often than their parts would.

Texts are read once: each task writes its texts as codes of its own words, with those words' counts. Words that are
frequent in their language get global ids; a task's codes become ids, and every other word breaks a piece. Each position
then gives one window of ids in a key of fixed width. Windows are sorted by radix and run-length counted where they are,
dealt out by ranges of the key, and sorted and counted again there. As the windows of a range are sorted, runs of
their first two, three, ... ids give the counts of the shorter phrases; only a run at a range's edge goes on elsewhere.
"""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, remove, shared_folder

#: Tokens of a chunk of codes, and about the windows of a range of keys and the least number of ranges.
CHUNK, RANGE, RANGES = 1 << 20, 1 << 21, 64
#: Bytes of a text that are taken apart at a time.
SLICE = 1 << 20
#: Chunks, and windows of each, from which the ranges' bounds are taken: they bear on balance alone.
SAMPLED_CHUNKS, SAMPLED_WINDOWS = 64, 1024
#: Salts of a language before its best phrases meet.
SALTS = 32
#: A-Z lower-cased, what ends a piece as a line feed, a tab as a space.
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
CODES = "chunk long, lang string, tokens long, wide boolean, codes binary, words array<string>, counts array<long>"


class Codes(dict):
    """A word's code, in the order in which words are met; 0 ends a piece."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def coded(batches):
    """Texts as chunks of codes, one language each. A piece never goes on from one text to the next."""
    held: dict = {}
    made = TaskContext.get().partitionId() << 32

    def chunk(lang):
        nonlocal made
        codes, stream = held.pop(lang)
        made += 1
        stream = np.frombuffer(stream, np.int32)
        wide = len(codes) > 1 << 16
        data = pa.compress(stream.astype(np.uint32 if wide else np.uint16).tobytes(), codec="zstd", asbytes=True)
        words, counts = [w.decode() for w in codes][1:], np.bincount(stream, minlength=len(codes))[1:]
        return pa.RecordBatch.from_arrays(
            [pa.array([made]), pa.array([lang]), pa.array([len(stream)]), pa.array([wide]), pa.array([data], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
            ["chunk", "lang", "tokens", "wide", "codes", "words", "counts"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_buffer().to_pybytes().translate(CLEAN) if text.is_valid else b""
            if lang not in held:
                held[lang] = Codes(), array("i")
            codes, stream = held[lang]
            at = 0
            while at < len(text):
                # At a space, so that no word and no piece is cut.
                end = text.find(b" ", at + SLICE)
                end = len(text) if end < 0 else end
                stream.extend(map(codes.__getitem__, filter(None, text[at:end].replace(b"\n", b" \n ").split(b" "))))
                at = end
            stream.append(0)
            if len(stream) >= CHUNK or sum(len(s) for _, s in held.values()) >= 4 * CHUNK:
                yield chunk(lang)
    for lang in list(held):
        yield chunk(lang)


def id_stream(row, digits: int) -> np.ndarray:
    """A chunk's codes as ids; 0 for the end of a piece and for words without one."""
    codes = np.frombuffer(pa.decompress(row["codes"], decompressed_size=row["tokens"] * (4 if row["wide"] else 2), codec="zstd"), np.uint32 if row["wide"] else np.uint16)
    known = np.zeros(int(codes.max(initial=0)) + 1, np.uint32 if digits == 2 else np.uint16)
    for pair in row["known"] or ():
        known[pair["code"]] = pair["id"]
    return known[codes]


def windows(ids: np.ndarray, first: int, last: int, longest: int, digits: int) -> np.ndarray:
    """The windows that start in ids[first:last] with two ids or more, as columns of 16-bit digits; ids after a break are 0."""
    part = np.concatenate([ids[first : last + longest - 1], np.zeros(max(0, last + longest - 1 - len(ids)), ids.dtype)])
    n, columns = last - first, [part[: last - first]]
    alive = columns[0] > 0
    for k in range(1, longest):
        alive = alive & (part[k : k + n] > 0)
        columns.append(np.where(alive, part[k : k + n], 0))
    keep = columns[1] > 0
    columns = [c[keep] for c in columns]
    return np.array([d for c in columns for d in ((c >> 16, c & 0xFFFF) if digits == 2 else (c,))], np.uint16).reshape(longest * digits, -1)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of fixed-width keys (columns of 16-bit digits): one stable radix pass a digit, last digit first."""
    order = np.arange(keys.shape[1])
    for digit in keys[::-1]:
        if len(order) and digit.max() > digit.min():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def starts_of_runs(keys: np.ndarray) -> np.ndarray:
    """Where a key of sorted keys differs from the one before."""
    if not keys.shape[1]:
        return np.zeros(0, np.int64)
    return np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))])


def as_bytes(keys: np.ndarray) -> np.ndarray:
    """Keys as byte strings of fixed width whose order is that of the digits."""
    return np.ascontiguousarray(keys.T.astype(">u2")).view(f"S{2 * len(keys)}").ravel()


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often they are there."""
    order = radix_order(keys)
    keys = keys[:, order]
    starts = starts_of_runs(keys)
    if counts is None:
        return keys[:, starts], np.diff(np.append(starts, keys.shape[1]))
    return keys[:, starts], np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)


def phrase_counts(docs: DataFrame, least: int, longest: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: id, lang, word, f), (phrases: ids, f) of ``least`` occurrences or more, and (lang, n)."""
    spark = docs.sparkSession
    docs.mapInArrow(coded, CODES).write.parquet(f"{folder}/codes")
    chunks = spark.read.schema(CODES).parquet(f"{folder}/codes")
    spelt = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("chunk", "lang", (F.col("code") + 1).alias("code"), "w.words", "w.counts")
    totals = cut(spelt.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")))
    sizes = cut(totals.groupBy("lang").agg(F.sum("f").alias("n")))
    words = cut(totals.where(F.col("f") >= least).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    # A row for each partition of the table of words.
    offsets = words.groupBy(part.alias("part")).agg(F.count("*").alias("size")).withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size")).drop("size")
    words = cut(words.withColumn("part", part).join(F.broadcast(offsets), "part").select((F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1) + 1).alias("id"), "lang", "word", "f"))
    frequent, tokens = words.count(), chunks.agg(F.sum("tokens")).first()[0] or 0  # two numbers
    if frequent >= 1 << 32:
        raise ValueError("more frequent words than a key has room for")
    digits = 1 if frequent < 1 << 16 else 2
    known = spelt.select("chunk", "lang", "code", F.col("words").alias("word")).join(words.drop("f"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    chunks = chunks.select("chunk", "tokens", "wide", "codes").join(known, "chunk")

    def sampled(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_stream(row, digits)
                found = windows(ids, 0, len(ids), longest, digits)
                yield pa.RecordBatch.from_arrays([pa.array([x.ljust(2 * longest * digits, b"\0") for x in as_bytes(found[:, :: -(-max(1, found.shape[1]) // SAMPLED_WINDOWS)]).tolist()], pa.binary())], ["key"])

    every = -(-chunks.count() // SAMPLED_CHUNKS)
    # At most SAMPLED_CHUNKS * SAMPLED_WINDOWS keys of 20 bytes, but for the chance of the hash.
    some = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(max(1, every))) == 0).limit(2 * SAMPLED_CHUNKS)
    seen = sorted(r[0] for r in some.mapInArrow(sampled, "key binary").collect())
    ranges = max(RANGES, -(-tokens // RANGE))
    bounds = np.array(sorted({bytes(seen[len(seen) * k // ranges]) for k in range(1, ranges)}) if seen else [], f"S{2 * longest * digits}")

    def dealt(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_stream(row, digits)
                for at in range(0, len(ids), CHUNK):
                    keys, counts = counted(windows(ids, at, min(at + CHUNK, len(ids)), longest, digits))
                    edges = [0, *np.searchsorted(as_bytes(keys), bounds).tolist(), keys.shape[1]]
                    parts = [(r, a, b) for r, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                    data = [pa.compress(keys[:, a:b].tobytes() + counts[a:b].astype(np.uint32).tobytes(), codec="zstd", asbytes=True) for _, a, b in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in parts], pa.int32()), pa.array([b - a for _, a, b in parts], pa.int64()), pa.array(data, pa.binary())], ["range", "n", "data"])

    width = longest * digits

    def merged(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for n, data in zip(table["n"].to_pylist(), table["data"]):
            raw = pa.decompress(data.as_py(), decompressed_size=n * (2 * width + 4), codec="zstd", asbytes=True)
            keys.append(np.frombuffer(raw, np.uint16, n * width).reshape(width, n))
            counts.append(np.frombuffer(raw, np.uint32, n, 2 * n * width).astype(np.int64))
        keys, counts = counted(np.concatenate(keys, axis=1), np.concatenate(counts))
        out, totals = [], []
        for m in range(2, longest + 1):
            starts = starts_of_runs(keys[: m * digits])
            f = np.add.reduceat(counts, starts)
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            full = keys[(m - 1) * digits : m * digits, starts].any(axis=0)
            kept = starts[full & (edge | (f >= least))]
            found = keys[: m * digits, kept].astype(np.int64)
            found = (found[::2] << 16 | found[1::2]) if digits == 2 else found
            out += found.T.tolist()
            totals += f[full & (edge | (f >= least))].tolist()
        return pa.table([pa.array(out, pa.list_(pa.int64())), pa.array(totals, pa.int64())], ["ids", "f"])

    counts = chunks.mapInArrow(dealt, "range int, n long, data binary").groupBy("range").applyInArrow(merged, "ids array<long>, f long")
    phrases = cut(counts.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    return words, phrases, sizes


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, inside: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``longest`` words.

    ``a`` counts the phrase (``least`` or more), ``l`` and ``r`` its two parts at the cut of the lowest score, ``n`` the
    language's words. A phrase inside a longer one that has ``inside`` percent of its occurrences or more is dropped.
    Null texts are empty, null languages are ``und`` and empty texts have no phrases; repeated rows count each time;
    other columns do not matter; an empty table gives no rows. A text of any length is read whole, in slices.
    """
    if not 2 <= longest or least < 1:
        raise ValueError("phrases have two words or more and occur")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    given = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    words, phrases, sizes = phrase_counts(given, least, longest, folder)
    remove(spark, folder)
    counts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    # A longer phrase is never more frequent than one inside it, so those of one word more decide.
    one_less = lambda at: F.slice("ids", at, F.size("ids") - 1)
    longer = phrases.where(F.size("ids") > 2).select(F.explode(F.array(one_less(1), one_less(2))).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = phrases.withColumnRenamed("f", "a").join(longer, "ids", "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True))).drop("longer")
    kept = kept.withColumn("id", F.col("ids")[0]).join(words.select("id", "lang"), "id").drop("id").join(F.broadcast(sizes), "lang")  # a row for each language
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cuts = cuts.join(counts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", whole("a") * (whole("n") * 1000).cast("decimal(19,0)")).withColumn("under", whole("l") * whole("r")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r")
    told = best.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    told = told.groupBy("lang", "ids", "a", "n", "score", "l", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    told = told.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return told.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
