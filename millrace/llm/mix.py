"""Mixing sources to target weights by nested hash thresholds.

Every document gets a bucket from a hash of its id. A histogram of tokens by source and bucket gives, for each source, the bucket in which its
budget ends; only that boundary bucket is refined by the next digits of the hash, and a document is then kept by comparing its hash with its
source's threshold. Nothing is sorted, and the only rows that meet in one place are sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, read_table, words_in

NAME = "op5_mix_sources"


def _digits(seed: int, key: Column, start: int, digits: int) -> Column:
    """Some hex digits of a document's hash, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), start, digits), 16, 10).cast("long")


def _name(docs: DataFrame) -> Column:
    """What a document's hash is of: its id, or its text where that is null, so that rows without an id do not share one fate."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """One row per source of `sizes` (source, source_size): its target.

    Sources in order of code points, null last, weigh weights[0], weights[1], ... repeating. All targets together are the sum of all sizes; a target
    stops at max_epochs times its source's size and the excess goes to the others by weight. That is the least level L with
    sum(min(cap, L * weight)) = total: sources sorted by cap / weight are capped up to the first at which the level holds.
    """
    at = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    ratio = (F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = W.orderBy(*ratio).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(*ratio).rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.orderBy(*ratio).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = weighed.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # where a source's cap is not under the level of itself and all after it, none from there on is capped
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(*ratio, F.col("level").alias("level")))).over(whole)["level"]
    return levels.withColumn("at", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """For each document how often the mix takes it: the columns of docs, then size, source_size, target, copies and taken.

    A source takes every document floor(target / source_size) times and, to fill the rest, once more those whose hash lies under its threshold. The
    threshold has 24 bits (12 for the histogram, 12 more inside the boundary bucket), so what is taken misses the target by the documents of one
    hash value at most. Null texts have size 0; a null source is a source; rows that repeat an id share its hash and so its fate, rows
    without one are told apart by their texts; an empty table
    gives an empty result. Columns of docs that bear the names of results are replaced by them.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")])
    sized = docs.withColumn("size", words_in(F.col("text")))
    hashed = cut(sized.select("source", "size", _digits(seed, _name(docs), 1, 3).alias("bucket"), _digits(seed, _name(docs), 4, 3).alias("fine")))
    histogram = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
    targets = source_targets(histogram.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "rest", F.col("target") - F.col("__epochs") * F.col("source_size")
    )

    def beside(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
        """left with the columns that right has for the same source (null included) and the same values of also; all of left's rows stay."""
        named = right.select(*[F.col(c).alias(f"__{c}") if c in ("source", *also) else F.col(c) for c in right.columns])
        on = F.col("source").eqNullSafe(F.col("__source"))
        for c in also:
            on &= F.col(c) == F.col(f"__{c}")
        return left.join(named, on, "left").drop("__source", *[f"__{c}" for c in also])

    def boundary(hist: DataFrame, budgets: DataFrame, digit: str, budget: str) -> DataFrame:
        """The digit at which each budget ends and what is left of the budget there."""
        cumulated = beside(hist, budgets).withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy(digit)))
        over = cumulated.where(F.col("upto") > F.col(budget))
        return over.groupBy("source").agg(F.min(F.struct(F.col(digit), (F.col(budget) - F.col("upto") + F.col("tokens")).alias("left"))).alias("b")).select("source", F.col(f"b.{digit}").alias(digit), F.col("b.left").alias("left"))

    coarse = boundary(histogram, targets.select("source", "rest"), "bucket", "rest").withColumnRenamed("left", "fine_rest")
    inside = beside(hashed, coarse, "bucket").where("fine_rest IS NOT NULL").groupBy("source", "fine").agg(F.sum("size").alias("tokens"))
    refined = boundary(inside, coarse.select("source", "fine_rest"), "fine", "fine_rest").select("source", "fine")
    limits = beside(beside(targets, coarse.select("source", "bucket")), refined)
    limits = limits.select("source", "source_size", "target", "__epochs", (F.coalesce("bucket", F.lit(-1)) * 4096 + F.coalesce("fine", F.lit(0))).alias("__limit"))
    limits = cut(limits)  # a row per source: from its written size Spark sees whether it can be broadcast
    joined = beside(sized, limits).withColumn("__h", _digits(seed, _name(docs), 1, 6))
    copies = F.col("__epochs") + (F.col("__h") < F.col("__limit")).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*sized.columns, "source_size", "target", "copies", "taken")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with the columns of docs."""
    mixed = mix_sources(docs, **options).where("copies > 0")
    return mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))), 1, 6))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
c AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, encode(source)) AS i FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, i) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT *, target - epochs * source_size AS rest FROM e),
f AS (SELECT d.source, h, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d GROUP BY d.source, h),
b AS (SELECT r.source, coalesce((SELECT min(h) FROM f WHERE f.source IS NOT DISTINCT FROM r.source AND f.upto > r.rest), -1) AS lim FROM r)
SELECT d.doc_id, d.size, r.source_size, r.target, (r.epochs + (d.h < b.lim)::BIGINT) * d.size AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
