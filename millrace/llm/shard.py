"""Sharding by proportional stratified interleaving.

Within each source rows are shuffled by a seeded hash and ranked; a row's fractional rank is (rank - 1/2) / rows of the source. Sorted by it, any
stretch of rows holds every source in its proportion, so cutting the order into equal lengths gives shards that match the mixture.

Both rankings are done without a sort of the whole and without gathering a source: rows are counted by (source, slice of the hash) and by slices of
the fractional rank, running sums of those counts say where each slice starts, and rows are numbered inside their slice only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, parts, read_table

NAME = "op10_shard_interleaved"
_FULL = 1 << 32


def shard(docs: DataFrame, shards: int = 24, seed: int = 11, slices: int | None = None) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of each row of docs.

    size is the text's UTF-8 bytes plus 8 (8 for null). Shards differ by one row at most. slices (by default 8 times the session's shuffle partitions)
    says how finely a source is dealt out for ranking. A null source is a source of its own; rows that agree in every column are interchangeable and
    take neighbouring places; an empty table gives no rows; fewer rows than shards leave shards empty. Only the columns doc_id, source and text are
    read, so others cannot clash.
    """
    slices = slices or 8 * parts(docs.sparkSession)
    rows = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.col("text").isNull().alias("__none"))
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size").bitwiseAND(_FULL - 1))
    rows = cut(rows.withColumn("__s", F.floor(F.col("__h") * slices / _FULL).cast("long")))

    # ranks inside each source
    by_slice = rows.groupBy("source", "__s").agg(F.count("*").alias("__n"))
    own = W.partitionBy("source")
    starts = by_slice.select("source", "__s", (F.sum("__n").over(own.orderBy("__s")) - F.col("__n")).alias("__from"), F.sum("__n").over(own).alias("__of"))
    ties = ["__h", "doc_id", "text_crc32", "size", "__none"]
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy("source", "__s").orderBy(*ties))).alias("a")
    ranked = ranked.join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.__s") == F.col("b.__s")))
    ranked = ranked.select("a.*", ((F.col("b.__from") + F.col("__r") - 0.5) / F.col("b.__of")).alias("__f")).drop("__s", "__r")

    # places in the order by fractional rank
    ranked = cut(ranked.withColumn("__s", F.floor(F.col("__f") * slices).cast("long")))
    by_rank = ranked.groupBy("__s").agg(F.count("*").alias("__n"))
    places = by_rank.select("__s", (F.sum("__n").over(W.orderBy("__s")) - F.col("__n")).alias("__from"), F.sum("__n").over(W.partitionBy()).alias("__of"))
    placed = ranked.withColumn("__r", F.row_number().over(W.partitionBy("__s").orderBy("__f", "source", *ties))).join(places, "__s")
    # shard k holds the places from floor(k * rows / shards) up to the next shard's first
    placed = placed.withColumn("__g", F.col("__from") + F.col("__r") - 1).withColumn("shard", F.expr(f"(__g * {shards} + {shards - 1}) div __of"))
    return placed.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.expr(f"__g - (shard * __of) div {shards}").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE_SQL = None  # neither crc32 nor xxhash64 exist in DuckDB; tests/llm holds it against a brute-force version
