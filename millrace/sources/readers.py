"""Sources: Kafka options, framed Avro, incremental JDBC tables, queries, files."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import deep, names, paths


def kafka_options(brokers: list[str], topic: str, group: str = "millrace", tls: dict | None = None, sasl: dict | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source: all of a topic from the oldest record on."""
    options = {"kafka.bootstrap.servers": ",".join(brokers), "subscribe": topic, "startingOffsets": "earliest", "includeHeaders": "true", "kafka.group.id": group}
    if tls or sasl:
        options["kafka.security.protocol"] = ("SASL_" if sasl else "") + ("SSL" if tls else "PLAINTEXT")
    for key, value in (tls or {}).items():
        options[f"kafka.ssl.{key}"] = str(value)
    if sasl:
        mechanism = sasl.get("mechanism", "PLAIN").upper()
        module = "scram.ScramLoginModule" if mechanism.startswith("SCRAM") else "plain.PlainLoginModule"
        options["kafka.sasl.mechanism"] = mechanism
        options["kafka.sasl.jaas.config"] = f'org.apache.kafka.common.security.{module} required username="{sasl["username"]}" password="{sasl["password"]}";'
    return options


def from_kafka(records: DataFrame) -> DataFrame:
    """Message rows (value, meta, ts, headers) of Kafka records; works on streams."""
    meta = F.create_map(*[x for c in ("topic", "partition", "offset", "key") for x in (F.lit(c), F.col(c).cast("string"))])
    return records.select("value", meta.alias("meta"), F.col("timestamp").alias("ts"), *([F.col("headers")] if "headers" in records.columns else []))


def split_frame(value: Column) -> Column:
    """A struct (framed, schema_id, payload) of a binary value: a zero byte, four bytes of schema id and the record, or else all payload."""
    framed = (F.substring(value, 1, 1) == F.lit(b"\x00")) & (F.octet_length(value) > 5)
    schema_id = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).try_cast("int")
    return F.struct(F.coalesce(framed, F.lit(False)).alias("framed"), F.when(framed, schema_id).alias("schema_id"), F.when(framed, F.substring(value, 6, 2**31 - 1)).otherwise(value).alias("payload"))


def decode_avro(df: DataFrame, schemas: dict[int, str] | str, value: str = "value") -> DataFrame:
    """Rows whose Avro value decodes, as a column record; others are skipped (undecoded() tells those whose frame is at fault). Needs the spark-avro package. schemas: one for raw values, or by id."""
    from pyspark.sql.avro.functions import from_avro

    if isinstance(schemas, str):
        return df.withColumn("record", from_avro(F.col(value), schemas, {"mode": "PERMISSIVE"})).where("record IS NOT NULL")
    frame = df.withColumn("__frame", split_frame(F.col(value)))
    record = F.coalesce(*[F.when(F.col("__frame.schema_id") == i, from_avro(F.col("__frame.payload"), s, {"mode": "PERMISSIVE"})) for i, s in schemas.items()])
    return frame.withColumn("record", record).where("record IS NOT NULL").drop("__frame")


def undecoded(df: DataFrame, ids: list[int], value: str = "value") -> DataFrame:
    """The rows that decode_avro skips for their frame when it has schemas for ids, with the reason as a column error: for an error sink, or to be counted. Works on streams."""
    frame = split_frame(F.col(value))
    known = F.coalesce(frame["schema_id"].isin(ids), F.lit(False)) if ids else F.lit(False)
    unknown = F.concat(F.lit("unknown schema id "), F.coalesce(frame["schema_id"].cast("string"), F.lit("out of range")))
    error = F.when(F.col(value).isNull(), "no value").when(~frame["framed"], "no frame").when(~known, unknown)
    return df.withColumn("error", error).where("error IS NOT NULL")


def unwrap_arrays(value: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """A value in which every struct whose only field is an array named array is replaced by that array, at any depth."""
    if isinstance(kind, T.StructType) and kind.names == ["array"] and isinstance(kind["array"].dataType, T.ArrayType):
        return unwrap_arrays(value["array"], kind["array"].dataType)
    if isinstance(kind, T.StructType):
        parts = [(f.name, *unwrap_arrays(value[f.name], f.dataType)) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*[c.alias(n) for n, c, _ in parts])), T.StructType([T.StructField(n, t) for n, _, t in parts])
    if isinstance(kind, T.ArrayType):
        inner = unwrap_arrays(F.lit(None), kind.elementType)[1]
        return F.transform(value, lambda x: unwrap_arrays(x, kind.elementType)[0]), T.ArrayType(inner)
    return value, kind


def unwrap_all(df: DataFrame) -> DataFrame:
    return df.select(*[unwrap_arrays(F.col(f"`{f.name}`"), f.dataType)[0].alias(f.name) for f in df.schema.fields])


def unwrap_bodies(df: DataFrame) -> DataFrame:
    """df with the same done to its bodies, at all depths below their own keys. Bodies in which a place holds different kinds of values are rewritten as text."""
    shape = None if df.isStreaming else deep.body_shape(df)
    if shape is not None:
        return df.withColumn(paths.BODY, paths.once(F.col(paths.BODY), lambda b: F.when(b.isNotNull(), deep.entries(b, shape.levels, unwrap=True))))

    def walk(x):
        if isinstance(x, dict):
            return walk(x["array"]) if list(x) == ["array"] and isinstance(x["array"], list) else {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def unwrapped(texts: pd.Series) -> pd.Series:
        keep = lambda t: json.dumps({k: walk(v) for k, v in json.loads(t, parse_float=names.ExactNumber).items()}, ensure_ascii=False)
        return texts.map(lambda t: None if t is None else keep(t))

    return df.withColumn(paths.BODY, F.from_json(unwrapped(F.to_json(paths.BODY)), "map<string,variant>"))


def to_messages(df: DataFrame, table: str, key: str | None = "id") -> DataFrame:
    """Rows of a table as JSON objects by column name, nulls included, with metadata table and id."""
    meta = [F.lit("table"), F.lit(table)] + ([F.lit("id"), F.col(key).cast("string")] if key and key in df.columns else [])
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), F.create_map(*meta).alias("meta"))


@dataclass
class Incremental:
    """Reads of a table that only bring what is new: by an integer key, or by a time column where there is no key.

    read() gives rows after the mark, from whatever reader opens the table; a JDBC or parquet scan gets the comparison pushed down."""

    open: Callable[[], DataFrame]
    key: str | None = "id"
    created: str = "created_at"

    def column(self, df: DataFrame) -> str:
        return self.key if self.key and self.key in df.columns and isinstance(df.schema[self.key].dataType, T.IntegralType) else self.created

    def read(self, mark=None) -> DataFrame:
        df = self.open()
        column = self.column(df)
        return df if mark is None else df.where(F.col(column) > F.lit(mark))

    def advance(self, mark=None) -> tuple[DataFrame, object]:
        """(rows after mark and up to what the table reaches now, that end): rows that arrive meanwhile are left to the next call."""
        df = self.open()
        column = self.column(df)
        upper = df.agg(F.max(column)).first()[0]
        if upper is None or (mark is not None and upper <= mark):
            return df.where(F.lit(False)), mark
        new = df.where(F.col(column) <= F.lit(upper))
        return (new if mark is None else new.where(F.col(column) > F.lit(mark))), upper

    def deliver(self, write: Callable[[DataFrame], None], stored: str) -> object:
        """Read on from the mark stored in a folder, write, then store the new mark: a failed write leaves the mark, so rows come at least once.

        For batch jobs; a stream (polling.poll) has its mark in the checkpoint. A folder that is not there means that nothing was read yet."""
        spark = self.open().sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        mark = spark.read.parquet(stored).agg(F.max("mark")).first()[0] if there else None
        new, upper = self.advance(mark)
        if upper != mark:
            write(new)
            spark.createDataFrame([(upper,)], ["mark"]).coalesce(1).write.mode("append").parquet(stored)
        return upper

    def next_mark(self, batch: DataFrame, mark=None):
        found = batch.agg(F.max(self.column(batch))).first()[0]
        return mark if found is None else found


def jdbc_table(spark: SparkSession, url: str, table: str, partitions: tuple[str, int, int, int] | None = None, **options) -> Callable[[], DataFrame]:
    """A reader of a table; partitions (column, low, high, number) reads it in parallel."""

    def read() -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        if partitions:
            column, low, high, n = partitions
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
        return reader.load()

    return read


def jdbc_query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """The result of a query that the database runs, whole at every call."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def sql_query(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """The result of a query over DataFrames by name: joins, aggregates and windows enter a flow here."""
    return spark.sql(query, **tables) if "{" in query else _over_views(spark, tables, query)


def _over_views(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def read_files(spark: SparkSession, path: str, form: str = "parquet", schema: str | T.StructType | None = None, stream: bool = False) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).format(form)
    return (reader.schema(schema) if schema else reader).load(path)
