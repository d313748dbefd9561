"""The whole parse of sentences as they arrive.

A sentence is parsed on its own, so a micro-batch is parsed by the plan that parses a table, with no state and no
watermark. A batch's graphs go to a folder of its number, which is overwritten if the batch is run again after a
failure: each sentence is in the output once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import parsing
from graphloom.options import Settings


def parse_stream(sentences: DataFrame, knowledge: parsing.Knowledge, settings: Settings, out: str, progress: str, **trigger) -> StreamingQuery:
    """Parses the stream ``sentences`` into Parquet folders ``out``/batch=N; ``progress`` is the query's checkpoint folder.

    Both folders must be in a store that all executors reach. ``trigger`` goes to the writer's trigger, such as
    ``availableNow=True``. With ``settings.ignore_errors`` a sentence that fails has the empty graph and its reason.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsing.parse(batch, knowledge, settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = sentences.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    return (writer.trigger(**trigger) if trigger else writer).start()
