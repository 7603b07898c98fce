"""Writing to databases: merges that take effect once, target tables looked up and made, and rows that a database refuses.

Executors write rows; the driver only sends statements (through the JVM's own JDBC drivers) that the database runs as a whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "millrace_batches"
PRESENT = "present_columns"


@dataclass
class Database:
    """How to reach a database. options are those of Spark's JDBC reader and writer (user, password, driver, ...)."""

    url: str
    options: dict[str, str] = field(default_factory=dict)
    dialect: str = "standard"

    @contextmanager
    def transaction(self, spark: SparkSession) -> Iterator[Any]:
        """A connection whose statements take effect together, or not at all where the block fails."""
        jvm = spark.sparkContext._jvm
        login = jvm.java.util.Properties()
        for key, value in self.options.items():
            login.setProperty(key, str(value))
        if "driver" in self.options:
            jvm.java.lang.Class.forName(self.options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, login)
        try:
            connection.setAutoCommit(False)
            yield connection
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def append(self, df: DataFrame, table: str, batch_size: int = 1000) -> None:
        df.write.format("jdbc").options(url=self.url, dbtable=table, batchsize=str(batch_size), **self.options).mode("append").save()


def run(connection, sql: str, *values) -> int:
    """Run a statement; the number of rows it changed."""
    statement = connection.prepareStatement(sql)
    try:
        for i, value in enumerate(values, 1):
            statement.setObject(i, value)
        return statement.executeUpdate()
    finally:
        statement.close()


def columns_of(connection, table: str) -> list[tuple[str, str]]:
    """The columns (name, type) of a table as the database's catalog has them, in order; none if there is no such table."""
    meta = connection.getMetaData()
    schema, _, name = table.rpartition(".")
    for spelled in dict.fromkeys((name, name.upper(), name.lower())):
        found, rows = [], meta.getColumns(None, _spelled(connection, schema, spelled, name), spelled, None)
        while rows.next():
            if rows.getString("TABLE_NAME") == spelled:  # the argument is a pattern
                kind, size = rows.getString("TYPE_NAME"), rows.getInt("COLUMN_SIZE")
                if kind.lower() in ("decimal", "numeric"):
                    kind = f"{kind}({size},{rows.getInt('DECIMAL_DIGITS')})" if 0 < size <= 38 else f"{kind}(38,18)"
                found.append((rows.getInt("ORDINAL_POSITION"), rows.getString("COLUMN_NAME"), kind))
        rows.close()
        if found:
            return [(c, kind) for _, c, kind in sorted(found)]
    return []


def required_of(connection, table: str) -> list[str]:
    """The columns that must be given a value: not nullable, without a default and not counted up by the database."""
    meta = connection.getMetaData()
    schema, _, name = table.rpartition(".")
    for spelled in dict.fromkeys((name, name.upper(), name.lower())):
        out, any_, rows = [], False, meta.getColumns(None, _spelled(connection, schema, spelled, name), spelled, None)
        while rows.next():
            if rows.getString("TABLE_NAME") == spelled:
                any_ = True
                if rows.getString("IS_NULLABLE") == "NO" and rows.getString("COLUMN_DEF") is None and rows.getString("IS_AUTOINCREMENT") != "YES":
                    out.append(rows.getString("COLUMN_NAME"))
        rows.close()
        if any_:
            return out
    return []


def _spelled(connection, schema: str, name: str, given: str) -> str | None:
    return connection.getSchema() if not schema else schema.upper() if name == given.upper() != given else schema.lower() if name == given.lower() != given else schema


# Target tables


#: The statements that make a document table, by dialect.
DOCUMENT_TABLES = {
    "postgresql": [
        "CREATE TABLE IF NOT EXISTS {table} (id SERIAL PRIMARY KEY, data JSONB, created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP)",
        "CREATE INDEX IF NOT EXISTS {index} ON {table} USING GIN (data)",
    ],
    "trino": ["CREATE TABLE IF NOT EXISTS {table} (data VARCHAR)"],
    "standard": ["CREATE TABLE {table} (id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, data CLOB, created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP)"],
}


@dataclass
class Target:
    """A table as rows have to fit it. documents: each row goes as one JSON document into the column data."""

    table: str
    columns: list[tuple[str, str]]
    required: list[str]
    documents: bool


def target(spark: SparkSession, database: Database, table: str, create: bool = False) -> Target:
    """What the catalog says of a table, which is made as a document table where it is missing and create is set.

    A table takes documents if it has a column data of type JSON or JSONB, or if data is its only column that rows may bring (beside id and created_at).
    """
    with database.transaction(spark) as connection:
        found = columns_of(connection, table)
        if not found and create:
            index = f"{table.rpartition('.')[2]}_data_idx"
            for i, sql in enumerate(DOCUMENT_TABLES[database.dialect]):
                if i == 0:
                    run(connection, sql.format(table=table, index=index))
                else:  # an index helps but is no condition
                    _optional(connection, sql.format(table=table, index=index))
            found = columns_of(connection, table)
        if not found:
            raise ValueError(f"there is no table {table}")
        kinds = {c.lower(): kind.lower() for c, kind in found}
        documents = kinds.get("data", "") in ("json", "jsonb") or ("data" in kinds and set(kinds) <= {"id", "data", "created_at"})
        return Target(table, found, required_of(connection, table), documents)


def _optional(connection, sql: str) -> None:
    at = connection.setSavepoint()
    try:
        run(connection, sql)
    except Exception:
        connection.rollback(at)


def write_rows(df: DataFrame, database: Database, to: Target, batch_size: int = 1000) -> None:
    """Append message rows (a body, or typed columns) in the form the target takes: documents, or its columns with values brought to their types. Columns
    that no row can bring (counted up by the database or with a default) are left to the database if df lacks them."""
    from millrace.functions import coerce, paths
    from millrace.operators import sinks

    if to.documents:
        name = next(c for c, _ in to.columns if c.lower() == "data")
        return database.append(sinks.as_documents(df, name), to.table, batch_size)
    own = [(c, kind) for c, kind in to.columns if paths.is_dynamic(df) or c.lower() in {x.lower() for x in df.columns}]
    if not paths.is_dynamic(df):
        df = df.select(*[F.col(f"`{x}`").alias(next((c for c, _ in own if c.lower() == x.lower()), x)) for x in df.columns])
    database.append(coerce.align(df, own), to.table, batch_size)


# Merges


def fold(df: DataFrame, keys: list[str], at: str, update: bool, present: str | None = None) -> DataFrame:
    """One row for each key, with a text column PRESENT that has a character for each other column in order: 0 where no row brought it, 1 for a value, 2
    for a null, which is staged as '' in text columns (drivers differ in the type of a null text).

    at: the column that orders rows. With update the last row that brings a column sets it; without it the first row counts alone. present: an array column of the names a row brings;
    without one, or where it is null, a row brings all."""
    others = [c for c in df.columns if c not in keys and c not in (present, at)]
    brings = {c: F.lit(True) if present is None else F.coalesce(F.array_contains(present, c), F.lit(True)) for c in others}
    if update:
        picked = [F.max_by(F.struct(F.col(f"`{c}`").alias("v")), F.when(brings[c], F.col(at))).alias(c) for c in others]
        folded = df.groupBy(*keys).agg(F.count("*").alias("__n"), *picked)
        flags = {c: F.col(f"`{c}`").isNotNull() for c in others}
        values = {c: F.col(f"`{c}`")["v"] for c in others}
    else:
        folded = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(c) for c in others], *[brings[c].alias(f"brings {c}") for c in others], F.lit(1).alias("a row")), at).alias("__first"))
        flags = {c: F.col("__first")[f"brings {c}"] for c in others}
        values = {c: F.col("__first")[c] for c in others}
    flag = [F.when(~flags[c], "0").when(values[c].isNull(), "2").otherwise("1") for c in others]
    text = {c for c in others if isinstance(df.schema[c].dataType, T.StringType)}
    return folded.select(*keys, *[(F.coalesce(values[c], F.lit("")) if c in text else values[c]).alias(c) for c in others], F.concat_ws("", *flag).alias(PRESENT))


def merge_statement(table: str, staged: str, columns: list[str], keys: list[str], update: bool, dialect: str = "standard", present: str | None = None) -> str:
    """One statement that brings staged rows, one for each key, into a table: new keys are inserted, known ones updated or left.

    present: a column of the staged rows as fold() makes it; what a row did not bring keeps its old value."""
    others = [c for c in columns if c not in keys]

    def flag(c: str, row: str) -> str:
        return f"SUBSTR({row}.{present}, {others.index(c) + 1}, 1)"

    def staged_value(c: str) -> str:
        return f"s.{c}" if present is None or c in keys else f"CASE WHEN {flag(c, 's')} = '1' THEN s.{c} END"

    values = ", ".join(map(staged_value, columns))
    if dialect == "postgresql":
        own = f"(SELECT {{flag}} FROM {staged} p WHERE {' AND '.join(f'p.{k} = EXCLUDED.{k}' for k in keys)})"
        new = {c: f"EXCLUDED.{c}" if present is None else f"CASE WHEN {own.format(flag=flag(c, 'p'))} = '0' THEN {table}.{c} ELSE EXCLUDED.{c} END" for c in others}
        action = "DO UPDATE SET " + ", ".join(f"{c} = {new[c]}" for c in others) if update and others else "DO NOTHING"
        return f"INSERT INTO {table} ({', '.join(columns)}) SELECT {values} FROM {staged} s ON CONFLICT ({', '.join(keys)}) {action}"
    new = {c: f"s.{c}" if present is None else f"CASE WHEN {flag(c, 's')} = '0' THEN t.{c} WHEN {flag(c, 's')} = '1' THEN s.{c} END" for c in others}
    change = "WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{c} = {new[c]}" for c in others) + " " if update and others else ""
    return f"MERGE INTO {table} t USING {staged} s ON {' AND '.join(f't.{k} = s.{k}' for k in keys)} {change}WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({values})"


def mark(connection, query: str, batch: int) -> None:
    """Note that a batch of a query has taken effect; a second note of the same batch breaks the ledger's key."""
    run(connection, f"INSERT INTO {LEDGER} (query_id, batch_id) VALUES (?, ?)", query, batch)


def marked(connection, query: str, batch: int) -> bool:
    if not columns_of(connection, LEDGER):
        run(connection, f"CREATE TABLE {LEDGER} (query_id VARCHAR(200) NOT NULL, batch_id BIGINT NOT NULL, PRIMARY KEY (query_id, batch_id))")
        return False
    statement = connection.prepareStatement(f"SELECT 1 FROM {LEDGER} WHERE query_id = ? AND batch_id = ?")
    statement.setObject(1, query)
    statement.setObject(2, batch)
    try:
        return bool(statement.executeQuery().next())
    finally:
        statement.close()


def merge(
    df: DataFrame, database: Database, table: str, keys: list[str], order: list[Column], update: bool = True, batch: tuple[str, int] | None = None, present: str | None = None, batch_size: int = 1000
) -> bool:
    """Insert or update rows by key, once for a batch (query, number): False if that batch has taken effect before.

    Rows are reduced to one a key (see fold) and appended by executors to a staging table with the target's own types, one for each batch; then a
    merge and the batch's mark in the ledger are one transaction. Whatever fails before its end leaves the target as it was, so the batch can simply
    come again. Names of columns are matched to the target's without regard to case. Keys must not be null.
    """
    spark = df.sparkSession
    name = hashlib.md5(repr((table, batch or uuid.uuid4().hex)).encode()).hexdigest()[:12]
    staged = f"{table}_{name}"
    with database.transaction(spark) as connection:
        if batch and marked(connection, *batch):
            return False
        real = {c.lower(): c for c, _ in columns_of(connection, table)}
        brought = [c for c in df.columns if c != present]
        missing = [c for c in brought if c.lower() not in real]
        if missing or not real:
            raise ValueError(f"{table} has no columns {missing}")
        renamed = {c: real[c.lower()] for c in brought}
        named, keys = [renamed[c] for c in brought], [renamed.get(k, k) for k in keys]
        named = keys + [c for c in named if c not in keys]
        if columns_of(connection, staged):
            run(connection, f"DROP TABLE {staged}")
        quoted = ", ".join(f'"{c}"' for c in named)
        run(connection, f"CREATE TABLE {staged} AS SELECT {quoted}, CAST('' AS VARCHAR({max(1, len(named))})) AS \"{PRESENT}\" FROM {table} WITH NO DATA")
    try:
        rows = df.select(*[F.col(f"`{c}`").alias(renamed[c]) for c in brought], *([F.col(present).alias("__present")] if present else []), F.struct(*order).alias("__at"))
        if present:  # names as the target spells them
            spelled = F.create_map(*[x for c, r in renamed.items() for x in (F.lit(c.lower()), F.lit(r))])
            rows = rows.withColumn("__present", F.transform("__present", lambda c: spelled[F.lower(c)]))
        folded = fold(rows, keys, "__at", update, "__present" if present else None)
        database.append(folded.select(*named, PRESENT), staged, batch_size)
        with database.transaction(spark) as connection:
            run(connection, merge_statement(table, staged, [f'"{c}"' for c in named], [f'"{k}"' for k in keys], update, database.dialect, f'"{PRESENT}"'))
            if batch:
                mark(connection, *batch)
    finally:
        with database.transaction(spark) as connection:
            run(connection, f"DROP TABLE {staged}")
    return True


# Rows that a database refuses


def refusal(error: BaseException) -> bool:
    """Whether an error is about the rows that were written (a constraint, a value out of form), not about the connection or the server."""
    return any(c.__name__ in ("IntegrityError", "DataError") for c in type(error).__mro__)


def write_isolated(
    df: DataFrame, connect: Callable[[], Any], table: str, store: str, placeholder: str = "?", rows_a_write: int = 1000, refused: Callable[[BaseException], bool] = refusal, ledger: str | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Append rows from the executors; those that the database refuses come back, with the reason, from a table written to the folder store.

    Each task writes so many rows in a transaction. One that fails because of its rows is halved, and its halves are tried, down to the single
    rows at fault: about log2(rows_a_write) failed writes for each. Any other failure fails the task. connect: a DB-API 2.0 connection, made in each
    task. ledger: a table (chunk VARCHAR(200) PRIMARY KEY) that takes a row in each transaction, so that a task that runs again skips what it
    has written; df has to give the same rows in each partition then, as a persisted or written one does. carry: columns that are not written but
    come back with refused rows.
    """
    names = [c for c in df.columns if c not in carry]
    df = df.select(*names, *carry)
    sql = f"INSERT INTO {table} ({', '.join(f'"{c}"' for c in names)}) VALUES ({', '.join([placeholder] * len(names))})"
    schema = T.StructType([*df.schema.fields, T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        connection = connect()

        def once(chunk: str, rows: list[tuple]) -> None:
            cursor = connection.cursor()
            if ledger:
                cursor.execute(f"SELECT 1 FROM {ledger} WHERE chunk = {placeholder}", (chunk,))
                if cursor.fetchmany(1):
                    return
            try:
                if ledger:
                    cursor.execute(f"INSERT INTO {ledger} (chunk) VALUES ({placeholder})", (chunk,))
                cursor.executemany(sql, rows)
                connection.commit()
            except BaseException:
                connection.rollback()
                raise

        def attempt(lo: int, rows: list[tuple]) -> Iterator[tuple[int, str]]:
            try:
                once(f"{part}:{lo}:{len(rows)}", rows)
            except Exception as error:
                if not refused(error):
                    raise
                if len(rows) == 1:
                    yield lo, str(error)
                else:
                    half = len(rows) // 2
                    yield from attempt(lo, rows[:half])
                    yield from attempt(lo + half, rows[half:])

        seen = 0
        try:
            for whole in batches:
                for lo in range(0, whole.num_rows, rows_a_write):
                    b = whole.slice(lo, rows_a_write)
                    bad = list(attempt(seen, list(zip(*[c.to_pylist() for c in b.columns[: len(names)]], strict=True))))
                    if bad:
                        kept = b.take(pa.array([at - seen for at, _ in bad]))
                        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([reason for _, reason in bad])], names=schema.names)
                    seen += b.num_rows
        finally:
            connection.close()

    df.mapInArrow(run, schema).write.parquet(store)
    return df.sparkSession.read.schema(schema).parquet(store)
