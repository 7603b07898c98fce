"""Flows as Structured Streaming queries: offsets are committed after a batch is written, so every row is written at least once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import sinks
from millrace.plans.pipeline import Flow


class Folder:
    """Small files in a folder of whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path, spark.sparkContext._jvm
        self.files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self.files.exists(self._at(name))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.files.listStatus(self._at(""))] if self.has("") else []

    def put(self, name: str, text: str = "") -> None:
        out = self.files.create(self._at(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def get(self, name: str) -> str:
        stream = self.files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self.files.delete(self._at(name), True)


def guarded(
    spark: SparkSession, folder: str, batch_id: int, attempts: int = 3, wait: float = 0.5, patterns: tuple[str, ...] = sinks.TIMEOUTS, policy: Callable[[str], tuple[int, float, tuple[str, ...]]] | None = None
) -> Callable[[str, Callable[[], Any]], Any]:
    """Calls writes with retries, sink by sink, and marks each that is done for a batch in a folder, so that a batch that comes again skips them.

    policy gives (attempts, wait, patterns) by the sink's name; marks of earlier batches, which cannot come again, are deleted."""
    marks = Folder(spark, folder)
    for old in marks.names():
        if old.isdigit() and int(old) < batch_id:
            marks.drop(old)

    def run(name: str, write: Callable[[], Any]) -> Any:
        mark = f"{batch_id}/{hashlib.md5(name.encode()).hexdigest()}"
        if marks.has(mark):
            return None
        result = sinks.with_retry(write, *(policy(name) if policy else (attempts, wait, patterns)))
        if not isinstance(result, DataFrame):  # refused rows are still to be delivered
            marks.put(mark)
        return result

    return run


class Totals:
    """Rows processed and rows in error of all batches of a flow, kept beside its checkpoint: a file for a batch has the sums up to it, so a batch that
    comes again replaces what it has added, and a query that starts again counts on."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.folder = Folder(spark, f"{checkpoint}/totals")

    def _before(self, batch: int | None) -> list[int]:
        return sorted(int(n) for n in self.folder.names() if n.isdigit() and (batch is None or int(n) < batch))

    def read(self, batch: int | None = None) -> tuple[int, int]:
        """(processed, errors) of all batches, or of those before one."""
        known = self._before(batch)
        return tuple(json.loads(self.folder.get(str(known[-1])))) if known else (0, 0)

    def add(self, batch: int, processed: int, errors: int) -> None:
        before = self.read(batch)
        self.folder.put(str(batch), json.dumps([before[0] + processed, before[1] + errors]))
        for old in self._before(batch)[:-1]:
            self.folder.drop(str(old))


def start(
    flow: Flow, messages: DataFrame, checkpoint: str, default: Callable[[DataFrame], Any], writers: dict[str, Callable[[DataFrame], Any]] | None = None, errors: Callable[[DataFrame], None] | None = None, every: str | None = None, attempts: int | None = None, **options
) -> StreamingQuery:
    """Start a flow on streaming messages (value, ...). every: a trigger interval such as '5 seconds'; without it what is there is processed and the
    query ends. Each sink is retried alone, by the policy of its kind (attempts overrides how often), and one that has a batch is not given it again; a
    failure between a write and its mark may still repeat that write, so writers should be idempotent (database.merge with the batch's number is).
    Totals(spark, checkpoint) tells what all runs have processed. options go to Flow.write_batch."""

    def policy(name: str) -> tuple[int, float, tuple[str, ...]]:
        known = flow.policy(name)
        return (attempts or known[0], *known[1:])

    def batch(df: DataFrame, number: int) -> None:
        run = guarded(df.sparkSession, f"{checkpoint}/sinks", number, policy=policy)
        counted = flow.write_batch(df, writers or {}, default, errors, run=run, **options)
        Totals(df.sparkSession, checkpoint).add(number, *counted)

    stream = flow.plan(messages).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
