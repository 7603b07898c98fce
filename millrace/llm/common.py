"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words, as a regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write df to the shared folder, in folders by some columns, and read it back: later steps neither repeat its work nor depend on the executors that did it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what cut() has written for these tables; whatever was derived from them must have been written by then."""
    for df in tables:
        for path in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()[:1]}:  # above the folders by columns
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: how finely hot groups are split."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def words_in(text) -> F.Column:
    """The number of words in a text column; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def folded(text: bytes | None, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time: table turns each byte into what it counts as, and what separates terms into spaces."""
    text, lo = (text or b"").translate(table), 0
    while lo < len(text):
        hi = text.find(b" ", lo + size)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def lean(run: Callable[..., Iterator], *forget: Callable[[], None]) -> Callable[..., Iterator]:
    """run for mapInArrow, after whose end a Python worker gives back what it no longer needs: workers live on through all stages of a session, and what
    they keep adds up to the executors' memory. forget: functions of modules that empty what these keep in a worker."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for empty in forget:
                empty()
            give_back()

    return bounded


def give_back() -> None:
    """Return freed memory of Python, Arrow and the C library to the operating system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def hold_freed() -> None:
    """From now on the C library keeps up to 64 MB that numpy frees at hand, until give_back(): loops over small batches then don't fetch the same pages from the operating
    system again and again."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)  # not in every C library
    if tune is not None:
        tune(-3, 32 << 20)  # M_MMAP_THRESHOLD
        tune(-1, 64 << 20)  # M_TRIM_THRESHOLD
