"""Corpus operators on odd inputs and against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, decontaminate, langid, licences, linededup, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, shard string, n_words string, score string, lang_pred string, rejected string"
LONG = "word " * 3000 + "x" * 5000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with outputs."""
    rows = [(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (None, "the cat sat on the mat", None), (2, None, "en"), (3, "", "fr"), (4, LONG, "de"), (5, "!!! 123", None), (6, "a\nb\nc\nd\na\nb\nc", "en"), (7, "a\nb\nc", "en")]
    return spark.createDataFrame([(*r, "s", "n", "sc", "lp", "r") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


def test_sharding(odd, empty, spark):
    out = sharding.shuffle_into_shards(odd, 4).collect()
    assert len(out) == 9
    sizes = [sorted(r["slot"] for r in out if r["shard"] == s) for s in range(4)]
    assert sorted(map(len, sizes)) == [2, 2, 2, 3] and all(x == list(range(len(x))) for x in sizes)
    assert sharding.shuffle_into_shards(empty, 4).count() == 0


def test_hypergeometric_law(spark):
    from math import comb

    x = spark.range(4000).select(F.expr(sharding.hypergeometric("50L", "20L", "10L", sharding.unit(3, "id"))).alias("x")).groupBy("x").count().collect()
    for r in x:
        expected = 4000 * comb(20, r["x"]) * comb(30, 10 - r["x"]) / comb(50, 10)
        assert abs(r["count"] - expected) < 5 * (expected + 1) ** 0.5 + 3


def test_bpe_equals_library(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = bpe.WordTokenizer(open(path).read()), Tokenizer.from_file(path)
    rnd = random.Random(1)
    parts = ["ab the'sdre  \n\t", "!?.'-*#$<>", "éÉçßΣςİ", "日本가각", "̧́\x85\x1c ", "0²½"]
    texts = ["", "Hello <|endoftext|>x", "a" * 3000, "ab" * 1500, "é" * 900] + ["".join(rnd.choice(rnd.choice(parts)) for _ in range(60)) for _ in range(400)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == ids and own.decode(own.ids(t)) == lib.decode(ids, skip_special_tokens=False)
    out = bpe.encode(odd, path).collect()
    assert len(out) == 9 and all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert {r["n_tokens"] for r in out if not r["text"]} == {0}
    assert bpe.encode(empty, path).count() == 0


def test_golay_keys_meet():
    rnd = random.Random(3)
    a = np.array([rnd.getrandbits(64) for _ in range(500)], dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for p in rnd.sample(range(64), rnd.randint(0, 4)):
            b[i] ^= np.uint64(1 << p)

    def keys(v):
        found = [set() for _ in v]
        for k, i in zip(*(x.tolist() for x in simhash.bucket_keys(v.view(np.int64)))):
            found[i].add(k)
        return found

    assert all(x & y for x, y in zip(keys(a), keys(b)))


def test_simhash_components(odd, empty, spark):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == 9
    of = {r["key"]: r for r in out}
    assert of[2]["fp"] == of[3]["fp"] == 0 and of[3]["component_id"] == 2
    assert {r["component_id"] for r in out if r["key"] in (1, None)} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(300)]
    texts = []
    for i in range(60):
        w = list(base) if i % 2 else [rnd.choice(words) for _ in range(50)]
        if i % 2:
            w[rnd.randrange(300)] = "changed"
        texts.append(" ".join(w))
    got = {r["key"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fp = [simhash.fingerprint(t) & (2**64 - 1) for t in texts]
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(60), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert got == {i: find(i) for i in range(60)}


def test_decontamination(odd, empty, spark):
    schema = "item_id long, text string"
    bench = spark.createDataFrame([(1, "cat sat"), (2, None), (3, ""), (None, "the mat"), (12, "word " * 12)], schema)
    out = {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontaminate.decontaminate(odd, bench).collect()}
    assert (1, 4, ("1",)) in out and (4, 3000, ("12",)) in out and (2, 0, ()) in out and (3, 0, ()) in out
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not decontaminate.decontaminate(odd, bench.where("false")).where("contaminated").count()


def test_language_id(odd, empty, spark):
    model = langid.train(odd)
    out = langid.identify(odd, model).collect()
    assert len(out) == 9 and {r["lang_pred"] for r in out if not r["text"] or r["doc_id"] == 5} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_line_dedup(odd, empty, spark):
    out = {(r["doc_id"], r["text"], r["n_removed"]) for r in linededup.dedup_lines(odd).collect()}
    assert (6, "a\nb\nc\nd", 3) in out and (7, "", 3) in out and (2, None, 0) in out and (1, "the cat sat on the mat", 0) in out
    assert (None, "", 1) in out
    assert linededup.dedup_lines(empty).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a <|im_end|>\n\\e", 0.5), (1, 3, 1, "assistant", None, 2.0), (1, 4, 3, None, "thanks", 0.0), (2, 1, 9, "user", "lost", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, "user", "x", 0.0)]
    tree = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = chat.format_chats(tree, best=None).select("tree", "leaf", "rank", "formatted", "spans", chat.read_back(F.col("formatted")).alias("turns")).orderBy("rank").collect()
    assert [(r["tree"], r["leaf"]) for r in out] == [(1, 4), (1, 2)]
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", "q"), ("assistant", "a <|im_end|>\n\\e")]
    assert [(t["role"], t["text"]) for t in out[0]["turns"]] == [("user", "q"), ("assistant", ""), ("", "thanks")]
    assert chat.format_chats(tree.where("false")).count() == 0


def test_automaton_matches_brute_force():
    rnd = random.Random(2)
    sequences = [[rnd.randrange(4) for _ in range(rnd.randint(1, 12))] for _ in range(6)]
    a = licences.Automaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(100):
        w = [rnd.randrange(5) for _ in range(30)]
        longest = [max((k for k in range(i + 2) if k and tuple(w[i + 1 - k : i + 1]) in runs), default=0) for i in range(30)]
        want = [(i + 1 - longest[i], i + 1) for i in range(30) if longest[i] >= licences.LEAST and (i == 29 or longest[i + 1] <= longest[i])]
        assert [(s, e) for s, e, _ in a.matches(w)] == want


def test_licences(odd, empty, spark):
    texts = ["Released under the MIT License.", "x CC BY-NC 4.0 y all rights reserved", None, "", "GNU General Public License general public license"]
    out = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out] == [(0, None, None, ""), (2, 1, 7, "cc-by,reserved"), (0, None, None, ""), (0, None, None, ""), (2, 1, 4, "gpl")]
    assert out[0]["labels"] == "mit" and out[2]["score"] == 0
    assert licences.scan_licences(odd).count() == 9 and licences.scan_licences(empty).count() == 0


def test_toxicity(odd, empty, spark):
    rnd = random.Random(7)
    docs = [(i, " ".join(rnd.choice(["sun", "moon", "tree", "rock"]) for _ in range(20)) + (" idiot trash" if i % 4 == 0 else "") + (" scum" if i % 8 == 0 else "")) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    out = {r["doc_id"]: r for r in toxicity.grade_toxicity(frame, model).collect()}
    assert all(out[i]["toxic"] == (i % 4 == 0) for i in out)
    assert np.mean([out[i]["severity"] for i in range(0, 400, 8)]) > np.mean([out[i]["severity"] for i in range(4, 400, 8)])
    assert toxicity.grade_toxicity(odd, model).count() == 9 and toxicity.grade_toxicity(empty, model).count() == 0
    assert not toxicity.grade_toxicity(odd, toxicity.train(empty, labels.where("false"))).where("toxic").count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.001")
    assert first.columns == docs.columns and first.count() >= 0.97 * docs.count()
    rows = [(1, "the quick cat sat on it", "en"), (1, "the quick cat sat on it", "en"), (2, "the quick cat sat on it", "en"), (None, "another thing than that", None), (3, None, "en")]
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, small, "")
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]
