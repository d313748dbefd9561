"""The stateless front of parsing under Structured Streaming: documents in, tokens and candidates out.

Tokenising and pass-through candidates look at one document only, so the same plans run on a stream, with no
watermark and no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.parsing import from_source
from graphloom.sources.text import tokens


def document_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder of documents, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def candidate_stream(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    places = tokens(docs.select(F.col(id).alias("sent_id"), F.col(text).alias("text")), "sent_id", "text")
    return from_source("PassThrough", places.select("sent_id", F.col("idx").alias("start"), F.col("tok").alias("word"), F.lit(None).cast("string").alias("tag")))
