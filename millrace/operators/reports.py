"""Reports on flows: counts, rates, histograms and quantiles, as aggregations over rows of what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values: (first bound, number of bounds) of histograms whose bounds double.
BUCKETS = {"message_size": (64.0, 16), "processing": (0.001, 10), "transformer": (0.0001, 12), "stage": (0.0001, 14), "stage_latency": (0.0001, 12), "end_to_end": (0.001, 12)}


def bounds(kind: str) -> list[float]:
    first, n = BUCKETS[kind]
    return [first * 2**i for i in range(n)]


def counts(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def step_counts(df: DataFrame, steps: list) -> list[tuple[int, int]]:
    """(rows in, rows out) of each step of a chain, observed while one job runs the chain."""
    seen = [Observation() for _ in range(len(steps) + 1)]
    rows = F.count("*").alias("rows")
    current = df.observe(seen[0], rows)
    for step, after in zip(steps, seen[1:], strict=True):
        current = step(current).observe(after, rows)
    current.write.format("noop").mode("overwrite").save()
    counted = [o.get["rows"] for o in seen]
    return list(zip(counted[:-1], counted[1:], strict=True))


def run_totals(df: DataFrame, failed: Column, write=None) -> DataFrame:
    """One row (processed, errors) for a run that writes df: what it brought through and what failed, observed in the job that writes."""
    totals = Observation()
    bad = F.coalesce(failed, F.lit(False))
    observed = df.observe(totals, F.count("*").alias("processed"), F.count_if(bad).alias("errors"))
    (write or (lambda rows: rows.write.format("noop").mode("overwrite").save()))(observed)
    got = totals.get
    return df.sparkSession.createDataFrame([(got["processed"], got["errors"])], "processed long, errors long")


def throughput(df: DataFrame, labels: list[str], time: str = "ts", seconds: int = 10) -> DataFrame:
    """Rows per second in windows of some seconds; on streams with a watermark, too."""
    return df.groupBy(F.window(time, f"{seconds} seconds").alias("w"), *labels).agg((F.count("*") / F.lit(float(seconds))).alias("per_second")).select(F.col("w.start").alias("window_start"), *labels, "per_second")


def success_rate(df: DataFrame, failed: Column, labels: list[str]) -> DataFrame:
    """The share of rows that did not fail; 0 where there are none."""
    made = df.groupBy(*labels).agg(F.avg(F.when(F.coalesce(failed, F.lit(False)), 0.0).otherwise(1.0)).alias("success_rate"))
    return made.select(*labels, F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"))


def histogram(df: DataFrame, value: Column, kind: str, labels: list[str]) -> DataFrame:
    """Cumulative counts by upper bound le, the last being infinity; one pass, one number for each bound."""
    limits = bounds(kind)
    sums = df.where(value.isNotNull()).groupBy(*labels).agg(*[F.sum((value <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(limits)], F.count("*").alias(f"b{len(limits)}"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*limits, float("inf")])])
    return sums.select(*labels, F.explode(pairs).alias("p")).select(*labels, "p.le", "p.n")


def histogram_quantile(hist: DataFrame, q: float, labels: list[str]) -> DataFrame:
    """A quantile from cumulative counts, by linear interpolation inside its bucket; in the last bucket the largest finite bound."""
    ordered = W.partitionBy(*labels).orderBy("le") if labels else W.orderBy("le")
    whole = W.partitionBy(*labels)
    rows = hist.withColumn("low", F.coalesce(F.lag("le").over(ordered), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(ordered), F.lit(0))).withColumn("rank", F.lit(q) * F.max("n").over(whole))
    hit = rows.where("n >= rank AND n > 0").groupBy(*labels).agg(F.min(F.struct("le", "low", "n", "before", "rank")).alias("h"))
    inside = F.col("h.low") + (F.col("h.le") - F.col("h.low")) * (F.col("h.rank") - F.col("h.before")) / (F.col("h.n") - F.col("h.before"))
    return hit.select(*labels, F.when(F.col("h.le") == float("inf"), F.col("h.low")).otherwise(inside).alias("quantile"))


def rate(df: DataFrame, labels: list[str], time: str = "ts", minutes: int = 5) -> DataFrame:
    """Rows per second over windows of some minutes."""
    return throughput(df, labels, time, minutes * 60)


def counter_rate(samples: DataFrame, labels: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """Increase per second between the samples of a counter; a lower sample is a restart from 0. Samples without a time or value do not count; of samples at
    the same time, taken in order of value, the first alone has a rate. streaming.rates has the form for streams."""
    samples = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    w = W.partitionBy(*labels).orderBy(time, value)
    before, at = F.lag(value).over(w), F.lag(time).over(w)
    grown = F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1e6
    return samples.withColumn("rate", F.when(seconds > 0, grown / seconds)).where("rate IS NOT NULL")


def mean_duration(df: DataFrame, value: str, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.avg(value).alias("mean_duration"))


def latest(df: DataFrame, value: str, order: list[str], labels: list[str]) -> DataFrame:
    """The last value of each label set."""
    return df.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias(value))


def message_id(meta: Column) -> Column:
    """What a log calls a message: message_id, else id, else partition/offset, else offset, else ''."""
    first = lambda *names: F.coalesce(*[meta[n] for n in names])
    partition, offset = first("kafka_partition", "partition"), first("kafka_offset", "offset")
    return F.coalesce(meta["message_id"], meta["id"], F.when(partition.isNotNull() & offset.isNotNull(), F.concat_ws("/", partition, offset)), offset, F.lit(""))
