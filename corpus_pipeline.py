"""A corpus pipeline: toxicity, near-dedup, repeated passages, source mixture, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, and returns a DataFrame; its decisions take effect in what it returns.
run() applies all stages to the table `documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import minhash, mix, pack, substrings, toxicity
from millrace.llm.common import cut, read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a factorization machine, learned from the labelled documents of sf_dir, does not call toxic. Null texts and texts without a
    term stay by rule, whatever the model says of no terms. Equal texts share their fate; an empty table gives no rows."""
    model = toxicity.learn(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns], "text"), model)
    blank = ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return scored.where((F.col("predicted") == 0) | blank).select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null and empty texts stay."""
    named = docs.select(F.col("doc_id"), F.col("text"), F.struct(*docs.columns).alias("row"))
    return minhash.near_duplicates(named).where("keep").select("row.*")


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that repeat. A cut inside a character removes the rest of it; n_chars is counted anew."""
    named = docs.select(F.col("doc_id"), F.col("text"), F.struct(*docs.columns).alias("row"))
    out = substrings.remove_repeats(named).select("row", F.col("text").cast("binary").alias("new"), "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = [t if not r else substrings.whole_characters(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["row", "new"])

    kept = out.mapInArrow(run, T.StructType([f for f in out.schema.fields if f.name != "removed"])).select("row", F.col("new").cast("string").alias("new"))
    fields = {"text": F.col("new"), "n_chars": F.when(F.col("new").isNotNull(), F.length("new").cast("long"))}
    return kept.select(*[fields.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them. Documents without a word (null and empty texts) weigh nothing, so they are neither repeated nor
    dropped. Repeated rows are mixed one by one; a null source is a source; an empty table gives no rows."""
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    named = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(*docs.columns).alias("row"))
    return mix.mix_sources(named).where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens. A null or empty text is one piece of one token, repeated rows
    have pieces of their own, pieces of equal length are placed in any order; an empty table gives no rows."""
    return pack.query(spark, sf_dir, docs)


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", remove_passages), ("mix", mix_sources), ("pack", pack_sequences)]

ORACLE_SQL = None  # trained models and tokenizers; tests/llm holds each stage against its operator and a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
