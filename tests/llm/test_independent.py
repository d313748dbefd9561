"""Queries against plain versions written apart from the operators, on the smallest of the given tables plus odd rows."""

import math
import re
from collections import defaultdict

import pytest
import xxhash

from graphloom.llm import queries, toxicity

TABLES = "/root/testdata/sf0.001"
ODD = [(90_001, None), (90_002, ""), (90_003, "one"), (90_004, "ONE"), (90_005, "CC BY cc-by  CC\nBY"), (90_006, "GNU General Public License, all rights reserved"), (90_007, "é É word " * 3000), (90_008, " \t\n")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs.unionByName(odd).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{TABLES}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def bit_by_bit(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints_and_components(spark, folder):
    prints = {d: bit_by_bit(t) for d, t in texts(spark, folder).items()}
    up = {d: d for d in prints}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, folder).collect()}
    assert got == {d: (f"{f:016x}", top(d)) for d, f in prints.items()}


def test_phrases_of_licences(spark, folder):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    got = {r["doc_id"]: r for r in queries.op10_licences(spark, folder).collect()}
    for d, t in texts(spark, folder).items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
        r, at = got[d], [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_severity_is_the_models_own(spark, folder):
    """Every document's severity from the model's weights, features and thresholds, one formula at a time."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, folder).collect()}
    for d, t in texts(spark, folder).items():
        names = set()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            names |= {w, *("^" + w[:k] for k in (3, 4, 5, 6) if len(w) > k)}
        z = sum(v for k, v in model.weights.items() if k in names)
        above = [1 / (1 + math.exp(-min(40, max(-40, z - x)))) for x in model.thresholds]
        assert got[d]["severity"] == pytest.approx(sum(above)) and got[d]["p_toxic"] == pytest.approx(above[0]) and got[d]["toxic"] == (above[0] >= toxicity.TOXIC_AT)


def test_shards_and_slots(spark, folder):
    import zlib

    held, own = defaultdict(list), texts(spark, folder)
    for r in queries.op1_sharding(spark, folder).collect():
        data = (own[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        held[r["shard"]].append(r["slot"])
    assert sorted(held) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
