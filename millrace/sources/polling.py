"""Tables that grow, read as streams: what a batch brings is told by a mark (an integer key or a time), and the mark is the stream's offset.

Spark keeps offsets in the query's checkpoint, so a restarted query reads on where the last batch ended. The driver only asks for the next mark; rows are
fetched on the executors, a range of marks in each task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Table(Protocol):
    """What a polled table has to answer. Marks are integers, texts or times; low None is below all marks, and low itself is never included."""

    def next_mark(self, low: Any, limit: int | None) -> tuple[Any, int]:
        """(the mark of the limit-th row above low, or of the last one; how many rows that are); (None, 0) without rows."""

    def first_mark(self, high: Any) -> Any:
        """The least mark that is not above high."""

    def rows(self, low: Any, high: Any, columns: list[str]) -> Iterator:
        """The rows (tuples, or Arrow batches) above low up to high."""


@dataclass
class DatabaseTable:
    """A table behind a DB-API 2.0 driver. connect is called wherever rows are read, so it has to be picklable and must not hold a connection.

    placeholder: how the driver writes a parameter (`?`, or `%s`)."""

    connect: Callable[[], Any]
    table: str
    mark: str
    placeholder: str = "?"
    fetch: int = 1000

    def _ask(self, sql: str, *values) -> Iterator[tuple]:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(sql.replace("?", self.placeholder), values)
            while rows := cursor.fetchmany(self.fetch):
                yield from map(tuple, rows)
        finally:
            connection.close()

    def _between(self, low: Any, high: Any) -> tuple[str, list]:
        bounds = [(f'"{self.mark}" > ?', low), (f'"{self.mark}" <= ?', high)]
        held = [(sql, value) for sql, value in bounds if value is not None]
        return "".join(f" {'AND' if i else 'WHERE'} {sql}" for i, (sql, _) in enumerate(held)), [value for _, value in held]

    def next_mark(self, low: Any, limit: int | None) -> tuple[Any, int]:
        where, values = self._between(low, None)
        few = f' ORDER BY "{self.mark}" FETCH FIRST {limit} ROWS ONLY' if limit else ""
        return next(self._ask(f'SELECT max(q."{self.mark}"), count(*) FROM (SELECT "{self.mark}" FROM {self.table}{where}{few}) q', *values))

    def first_mark(self, high: Any) -> Any:
        where, values = self._between(None, high)
        return next(self._ask(f'SELECT min("{self.mark}") FROM {self.table}{where}', *values))[0]

    def rows(self, low: Any, high: Any, columns: list[str]) -> Iterator[tuple]:
        where, values = self._between(low, high)
        yield from self._ask(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM {self.table}{where}", *values)


@dataclass
class ParquetTable:
    """A folder of Parquet files that grows; files and row groups outside a range are skipped by their statistics."""

    path: str
    mark: str

    def _scan(self, low: Any, high: Any, columns: list[str]):
        import pyarrow.dataset as ds

        field, inside = ds.field(self.mark), None
        for bound in ([field > low] if low is not None else []) + ([field <= high] if high is not None else []):
            inside = bound if inside is None else inside & bound
        return ds.dataset(self.path, format="parquet").scanner(columns=columns, filter=inside)

    def next_mark(self, low: Any, limit: int | None) -> tuple[Any, int]:
        import pyarrow as pa
        import pyarrow.compute as pc

        least, count = None, 0
        for batch in self._scan(low, None, [self.mark]).to_batches():
            found = batch.column(0).drop_null()
            count += len(found)
            held = found if least is None else pa.concat_arrays([least, found])
            # no more than limit marks are kept from batch to batch
            least = held.take(pc.array_sort_indices(held)[:limit]) if limit else held.take(pc.array_sort_indices(held)[-1:])
        return (pc.max(least).as_py() if count else None), min(count, limit or count)

    def first_mark(self, high: Any) -> Any:
        import pyarrow.compute as pc

        least = [pc.min(b.column(0)).as_py() for b in self._scan(None, high, [self.mark]).to_batches()]
        return min((x for x in least if x is not None), default=None)

    def rows(self, low: Any, high: Any, columns: list[str]) -> Iterator:
        yield from self._scan(low, high, columns).to_batches()


@dataclass
class Range(InputPartition):
    low: Any
    high: Any


def _plain(mark: Any) -> dict:
    return {"time": mark.isoformat()} if isinstance(mark, datetime) else {"mark": mark}


def _mark(offset: dict) -> Any:
    return datetime.fromisoformat(offset["time"]) if "time" in offset else offset["mark"]


def ranges(low: Any, high: Any, number: int) -> list[Range]:
    """(low, high] in at most number parts of equal width; texts are not divided."""
    if isinstance(low, datetime) and isinstance(high, datetime):
        cuts = [low + (high - low) * k / number for k in range(1, number)]
    elif isinstance(low, int) and isinstance(high, int):
        cuts = [low + (high - low) * k // number for k in range(1, number)]
    else:
        cuts = []
    ends = [*sorted({c for c in cuts if low < c < high}), high]
    return [Range(a, b) for a, b in zip([low, *ends[:-1]], ends, strict=True)]


class PolledReader(DataSourceStreamReader):
    """Offsets are marks. A batch has at most max_rows rows (and those that share its last mark); while fewer than min_rows wait, and none for longer than
    max_delay seconds, there is no batch."""

    def __init__(self, table: Table, columns: list[str], tasks: int, max_rows: int | None, min_rows: int, max_delay: float):
        self.table, self.columns, self.tasks, self.max_rows, self.min_rows, self.max_delay = table, columns, tasks, max_rows, min_rows, max_delay
        self.at: dict | None = None
        self.waiting: float | None = None

    def initialOffset(self) -> dict:
        return {"mark": None}

    def latestOffset(self) -> dict:
        self.at = self.initialOffset() if self.at is None else self.at
        mark, rows = self.table.next_mark(_mark(self.at), self.max_rows)
        if not rows:
            return self.at
        self.waiting = time.monotonic() if self.waiting is None else self.waiting
        if rows < self.min_rows and time.monotonic() - self.waiting < self.max_delay:
            return self.at
        self.at, self.waiting = _plain(mark), None
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # a query that starts again from a checkpoint names its last offset here before it asks for a new one
        self.at = end if self.at is None else self.at
        low, high = _mark(start), _mark(end)
        if low == high:
            return []
        if low is not None:
            return ranges(low, high, self.tasks)
        # the first mark has a part of its own, as a range leaves its lower end out
        first = self.table.first_mark(high)
        return [Range(None, first), *(ranges(first, high, self.tasks) if first != high else [])]

    def read(self, partition: Range) -> Iterator:
        return self.table.rows(partition.low, partition.high, self.columns)


def poll(
    spark: SparkSession, table: Table, schema: str | T.StructType, name: str = "polled_table", tasks: int = 8, max_rows: int | None = None, min_rows: int = 1, max_delay: float = 60.0
) -> DataFrame:
    """A streaming DataFrame of a table's rows, from its first row on; how often it is asked is the query's trigger.

    Rows must not appear under marks that were passed (as with keys from a sequence whose transactions commit late). Rows with a null mark never come.
    max_rows, min_rows, max_delay: see PolledReader. With trigger(availableNow=True) a run is one batch, so max_rows bounds the run."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return kind

        def streamReader(self, schema: T.StructType) -> PolledReader:
            return PolledReader(table, kind.names, tasks, max_rows, min_rows, max_delay)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()
