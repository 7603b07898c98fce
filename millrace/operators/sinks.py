"""What sinks do to rows before and while they are written."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators import database


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row for each key: the first in order, or the last."""
    by = [c.desc() for c in order] if last else order
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target and those of the new rows whose key it lacks; of several new ones the first. A batch form: it gives the whole new table (database.merge
    changes a table in place)."""
    return target.unionByName(first_per_key(new, keys, order).join(target.select(*keys), keys, "left_anti").select(*target.columns), allowMissingColumns=True)


def upsert(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target after the new rows: each key's last one wins, columns that new lacks keep their values. A batch form, as insert_ignore is."""
    latest = first_per_key(new, keys, order, last=True).select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in new.columns if c in target.columns and c not in keys])
    joined = target.withColumn("__old", F.lit(True)).join(latest, keys, "full_outer")
    return joined.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if f"__{c}" in latest.columns else F.col(c) for c in target.columns])


def upsert_present(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """As upsert, but a null in new leaves the old value: only what a row brings is set."""
    held = first_per_key(new, keys, order, last=True).select(*keys, *[F.col(c).alias(f"__{c}") for c in new.columns if c in target.columns and c not in keys])
    joined = target.join(held, keys, "full_outer")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in held.columns else F.col(c) for c in target.columns])


def as_documents(df: DataFrame, column: str = "data") -> DataFrame:
    """Each row as one JSON document."""
    document = F.to_json(F.col(paths.BODY)) if paths.is_dynamic(df) else F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select(document.alias(column))


def kafka_record(df: DataFrame, topic: str | None = None) -> DataFrame:
    """key, value and, if given, topic of each row; a null key stays null."""
    key = F.col("meta")["key"] if "meta" in df.columns else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.col("value").cast("string").alias("value"), *([F.lit(topic).alias("topic")] if topic else []))


def error_envelope(payload: Column, message: Column, at: Column, sink: str, meta: Column) -> Column:
    """The document that an error sink gets for a row: its payload as an object if it is one, else as text under original_data."""
    is_object = F.from_json(payload, "map<string,variant>", {"allowSingleQuotes": "false"})
    error = F.struct(message.alias("message"), at.alias("timestamp"), F.lit(sink).alias("original_sink"), meta.alias("metadata"))
    original = F.when(is_object.isNotNull(), F.to_variant_object(is_object).cast("variant")).otherwise(F.to_variant_object(F.struct(payload.alias("original_data"))).cast("variant"))
    return F.to_json(F.struct(error.alias("error"), original.alias("original_message")))


def tag_bad(df: DataFrame, checks: list[tuple[Column, str]], column: str) -> DataFrame:
    """df with the reason of the first check each row fails; null for good rows. Filters on it stay above it: pushed below, they would parse bodies again at each mention."""
    reason = F.lit(None).cast("string")
    for ok, message in reversed(checks):
        reason = F.when(F.coalesce(ok, F.lit(False)), reason).otherwise(F.lit(message))
    return df.drop(column).select("*", F.explode(F.array(reason)).alias(column))


def split_bad(df: DataFrame, checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the reason of the first check they fail)."""
    tagged = tag_bad(df, checks, "__reason")
    return tagged.where("__reason IS NULL").drop("__reason"), tagged.where("__reason IS NOT NULL").withColumnRenamed("__reason", "reason")


class SinksFailed(RuntimeError):
    """Several sinks of one batch failed; failures has each one's error by name."""

    def __init__(self, failures: dict[str, BaseException]):
        super().__init__("; ".join(f"{name}: {error}" for name, error in failures.items()))
        self.failures = failures


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame], Any]], default: Callable[[DataFrame], Any], column: str = "route", run: Callable[[str, Callable[[], Any]], Any] | None = None, held: bool = False, threads: int = 4) -> dict[str, Any]:
    """Write each route's rows to its sink and all others to the default, from one computation of df; what each writer returned, by route.

    Sinks are written at the same time, by so many threads at most, each in a scheduler pool of its own, so that with
    spark.scheduler.mode=FAIR a slow one leaves room for the others. All are tried: a failing one doesn't stop others, and fails the batch in the end.
    run(name, write) calls each write, so that retries and guards see sinks one by one. held: df is persisted already."""
    run = run or (lambda _, write: write())
    known = list(sinks)
    rest = df.where(F.col(column).isNull() | ~F.col(column).isin(known)) if known else df
    parts = {route: (df.where(F.col(column) == route), write) for route, write in sinks.items()} | {"default": (rest, default)}
    spark = df.sparkSession

    def one(name: str) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sink {name}")
        part, write = parts[name]
        return run(name, lambda: write(part.drop(column)))

    if not held:
        df.persist()
    try:
        with ThreadPoolExecutor(max_workers=max(1, min(threads, len(parts)))) as pool:
            futures = {name: pool.submit(inheritable_thread_target(spark)(one), name) for name in parts}  # properties are copied for each
        failures = {name: f.exception() for name, f in futures.items() if f.exception() is not None}
        if len(failures) == 1:
            raise next(iter(failures.values()))
        if failures:
            raise SinksFailed(failures)
        return {name: f.result() for name, f in futures.items()}
    finally:
        if not held:
            df.unpersist()


def kafka_writer(brokers: list[str], topic: str, acks: str = "all", **options) -> Callable[[DataFrame], None]:
    """A writer of message rows (value, meta) to a topic."""
    settings = {"kafka.bootstrap.servers": ",".join(brokers), "kafka.acks": acks, "topic": topic, **options}
    return lambda df: kafka_record(df).write.format("kafka").options(**settings).save()


def as_document_table(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows for a table (data, created_at) that is made where it is missing; a key column is the database's."""
    return as_documents(df).withColumn("created_at", F.current_timestamp() if at is None else at)


def document_table(table: str, dialect: str = "postgresql") -> str:
    """The statement that makes a document table where there is none."""
    return database.DOCUMENT_TABLES.get(dialect, database.DOCUMENT_TABLES["trino"])[0].format(table=table)


merge_statement = database.merge_statement


def merge_jdbc(df: DataFrame, url: str, table: str, keys: list[str], order: list[Column], update: bool = True, dialect: str = "standard", batch: tuple[str, int] | None = None, present: str | None = None, **options) -> bool:
    """Insert or update rows by key through a staging table, once for each batch (see database.merge); options such as user and password are those of
    Spark's JDBC writer. Of several rows with a key the last in order counts (the first if update is false)."""
    return database.merge(df, database.Database(url, options, dialect), table, keys, order, update, batch, present)


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, mode: str = "append", **options) -> None:
    """Append rows to a table; a missing one is made from the columns."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size), **options).mode(mode).save()


#: Parts of error texts that mark a failure as passing; those in capitals count in capitals only.
TIMEOUTS = ("timeout", "deadline exceeded", "i/o timeout")
TRANSIENT = ("TOO_MANY_REQUESTS_FAILED", "transient", "worker node", "retry your query", "too many errors", "connect timeout", "under too much load", "the node may have crashed")
#: (attempts, seconds before the second, patterns) by kind of sink.
POLICIES = {"default": (3, 0.5, TIMEOUTS), "trino": (5, 2.0, TIMEOUTS + TRANSIENT)}


def passing(error: BaseException, patterns: tuple[str, ...] = TIMEOUTS) -> bool:
    text = str(error)
    return isinstance(error, TimeoutError) or any(p in (text if p.isupper() else text.lower()) for p in patterns)


def with_retry(write: Callable[[], Any], attempts: int = 3, wait: float = 0.5, patterns: tuple[str, ...] = TIMEOUTS, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Run an idempotent write again after failures that pass, doubling the wait; others fail at once."""
    for n in range(attempts):
        try:
            return write()
        except Exception as error:
            if n + 1 == attempts or not passing(error, patterns):
                raise
            sleep(wait * 2**n)
