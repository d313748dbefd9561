"""Each stage of the pipeline on odd rows, and the whole of it against what it should do."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, key string, of string, fp string, row string, kept string"
BODY = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood where nobody will ever find it again before the next long winter comes to an end"


@pytest.fixture(scope="module")
def odd(spark):
    words = BODY.split()
    near = " ".join([*words[:-1], "close"])
    rows = [(1, BODY, "en"), (1, BODY, "en"), (2, near, "en"), (3, None, "en"), (4, "", None), (None, "something else is written in this row of the table", None), (5, "a\nb\nc\nd\na\nb\nc", "en"), (6, "secret item words " * 4, "en"), (7, "long " * 20000, "en"), (8, "1 2 3 !", "en")]
    return spark.createDataFrame([(i, t, x, "s", None if t is None else len(t), *["clash"] * 7) for i, t, x in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "Secret item words secret item words secret item words secret"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    odd.write.parquet(f"{path}/documents.parquet")
    return path


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def of(*given):
    return sorted((i is None, i or 0) for i in given)


def test_stages_on_odd_rows(spark, odd, folder):
    stage = dict(corpus_pipeline.STAGES)
    # So few texts teach little: what language ID keeps of the others is not fixed here.
    known = stage["language_id"](spark, odd, folder)
    assert known.columns == odd.columns and {1, 2} <= {r["doc_id"] for r in known.collect()} <= {1, 2, 5, 6, 7, None}
    expected = {"line_dedup": set(), "decontamination": {6}}
    for name, gone in expected.items():
        out = stage[name](spark, odd, folder)
        assert out.columns == odd.columns
        assert ids(out) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect() if r["doc_id"] not in gone), name
    lines = {r["doc_id"]: r for r in stage["line_dedup"](spark, odd, folder).collect()}
    assert (lines[5]["text"], lines[5]["n_chars"]) == ("a\nb\nc\nd", 7) and lines[3]["text"] is None
    assert ids(stage["near_dedup"](spark, odd, folder)) == of(1, 3, None, 5, 6, 7, 8)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd.where("false"), folder).count() == 0, name


def test_encoding_equals_the_library(spark, odd, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    rows = dict(corpus_pipeline.STAGES)["encoding"](spark, odd, folder).collect()
    assert len(rows) == odd.count()
    for r in rows:
        given = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(given), hashlib.sha256(" ".join(map(str, given)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(given, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_its_stages(spark, odd, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(out) == plain(docs) and set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert {1} <= {r["doc_id"] for r in out.collect()} <= {1, None, 5, 7}
