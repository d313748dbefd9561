"""From documents to tokens: language ID, line dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, langid, linededup, nearcopies
from graphloom.llm.common import shared_folder, table

#: SQL cannot express the language models and the encoding.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject. Texts that are null, empty or without letters go.

    Repeated rows go or stay together; nulls in other columns do not matter (a row with a null id is not learned from);
    columns of any names are kept as they are, and an empty table gives no rows.
    """
    model = langid.train(docs.where(langid.learned_from(F.col("doc_id"))))
    judged = langid.identify(docs, model)
    return judged.where("not rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of repeated passages of three lines or over 50 words; ``n_chars`` follows the text.

    A text of which nothing is left becomes an empty one and its row stays; null texts stay null. Repeated rows are one
    document and are treated alike. Columns of any names are kept as they are, and an empty table gives no rows.
    """
    new = linededup.dedup_lines(docs, words=50)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more): the one with the least id (then text hash), nulls last.

    Of repeated rows one stays. Texts without words, null ones among them, are copies of one another. Columns of any
    names are kept as they are, and an empty table gives no rows.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))
    classes = nearcopies.near_copies(docs, key=key)
    # Written once: the copies of one row have one key, and one of them is to stay.
    first = classes.where("key <=> component_id").select("key.id", "key.of").distinct()
    # One key for the join and for repeated rows, so that texts are dealt out once.
    rows = docs.withColumn("__of", F.xxhash64("text")).withColumn("__k", F.xxhash64("doc_id", "__of")).alias("d")
    first = first.withColumn("k", F.xxhash64("id", "of")).alias("f")
    kept = rows.join(first, F.expr("d.__k = f.k and d.doc_id <=> f.id and d.__of = f.of"), "left_semi")
    return kept.dropDuplicates(["__k", "doc_id", "__of"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    Null and empty texts have no words and stay; repeated rows go or stay together; columns of any names are kept as
    they are; an empty table gives no rows, and an empty benchmark removes none.
    """
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.where("not contaminated").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, for every document that is left, beside doc_id, lang and source.

    A null text is an empty one. Every row gives a row, repeated ones too; an empty table gives none.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, path, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id", "lang", "source"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each result is Parquet in the shared folder.

    A stage's result goes once the next one's is written; the last stays, as the returned rows are read from it.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
