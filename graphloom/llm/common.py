"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that separates words once A-Z are lower-cased: ASCII without digits and a-z.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the folder all executors share, so that later stages do not recompute it.

    The folder is the session's ``spark.checkpoint.dir``; one of our own is set only where that is
    unset, as in tests on one machine.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is not set, and a local folder would not reach the executors")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def few(rows: int) -> int:
    """Partitions for a table of so many short rows: a task for each 50,000, so that small tables do not become many files."""
    return max(16, -(-rows // 50_000))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it was. Pure ASCII takes the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after A-Z are lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, inside expressions that cannot name columns."""
    return F.transform(F.array(value), body)[0]


def without(df: DataFrame, names) -> list[str]:
    """Columns of ``df`` but those that an operator's own output replaces, whatever their case."""
    own = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in own]


@lru_cache(1)
def _second_parts() -> frozenset:
    """Characters that may compose with one before them."""
    found = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    for cp in range(0x80, 0x20000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def fresh(c: str) -> bool:
    """A text may be cut before this character without changing its composed form."""
    return c < "\x80" or (not unicodedata.combining(c) and c not in _second_parts())


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Modules that remember things between tasks, each with a function ``forget``.
REMEMBERING = ("bpe", "langid", "nearcopies")


def let_go(but: str) -> None:
    """Makes this worker forget what operators other than ``but`` remember: workers outlive a stage, and would hold all of it.

    What is freed goes back to the system where the C library can be told to.
    """
    forgot = False
    for name in REMEMBERING:
        module = sys.modules.get(f"graphloom.llm.{name}")
        if module is not None and name != but:
            module.forget()
            forgot = True
    if forgot and sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
