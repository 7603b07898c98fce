"""Rates of counters on streams: the last sample of each series is state, and samples wait there until no earlier one can come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import reports

#: The last sample that has passed (microseconds, value), and those that wait.
_STATE = "at long, value double, times array<long>, values array<double>"


def counter_rate(samples: DataFrame, labels: list[str], time: str = "ts", value: str = "value", delay: str = "1 minute", idle: float | None = None) -> DataFrame:
    """labels, time, value and rate (increase per second since the sample before) on a stream of samples of counters; a lower sample is a restart from 0.

    Gives what reports.counter_rate gives on the same rows, in append mode: a sample comes out when the watermark, which is the latest time less `delay`,
    passes it, so samples may arrive in any order within the delay. Samples that come after the watermark has passed them are left out. The state of a
    series is its last sample and those inside the delay. A series without a sample for `idle` seconds of event time is forgotten, and its next sample
    has no rate; with None it is kept. Samples without a time or value do not count, null labels are a series of their own. Samples of a series
    at the same time are taken in order of value, and the first alone has a rate.
    """
    kinds = {f.name: f for f in samples.schema.fields}
    out = T.StructType([*[T.StructField(c, kinds[c].dataType) for c in labels], *T.StructType.fromDDL("__at long, __value double, rate double").fields])
    patience = None if idle is None else int(idle * 1e6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, times, values = state.get if state.exists else (None, None, [], [])
        parts = [] if state.hasTimedOut else [(f["__at"].to_numpy(), f["__value"].to_numpy()) for f in frames]
        t = np.concatenate([np.asarray(times, np.int64), *[p[0] for p in parts]])
        v = np.concatenate([np.asarray(values, np.float64), *[p[1] for p in parts]])
        order = np.lexsort((v, t))
        t, v, now = t[order], v[order], state.getCurrentWatermarkMs()
        n = int(np.searchsorted(t, now * 1000, "right"))  # these have passed
        if n:
            before_t, before_v = (t[:n], v[:n]) if at is None else (np.r_[at, t[:n]], np.r_[last, v[:n]])
            seconds, grown = np.diff(before_t) / 1e6, np.diff(before_v)
            after = before_v[1:]
            some = seconds > 0
            if some.any():
                rate = np.where(grown >= 0, grown, after)[some] / seconds[some]
                yield pd.DataFrame({**{c: pd.Series([k] * len(rate), dtype=object) for c, k in zip(labels, key, strict=True)}, "__at": before_t[1:][some], "__value": after[some], "rate": rate})
            at, last = int(t[n - 1]), float(v[n - 1])
        if n == len(t) and at is not None and patience is not None and at + patience <= now * 1000:
            if state.exists:
                state.remove()
            return
        state.update((at, last, t[n:].tolist(), v[n:].tolist()))
        due = int(t[n]) if n < len(t) else None if patience is None else at + patience
        if due is not None:
            state.setTimeoutTimestamp(max(due // 1000, now + 1))

    known = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull()).withWatermark(time, delay)
    rows = known.select(*labels, time, F.unix_micros(time).alias("__at"), F.col(value).cast("double").alias("__value"))
    # without labels all samples are one series, which one task has to follow
    keys = labels or [F.lit(0).alias("__all")]
    made = rows.groupBy(*keys).applyInPandasWithState(step if labels else lambda _, frames, state: step((), frames, state), out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(*labels, F.timestamp_micros("__at").alias(time), F.col("__value").alias(value), "rate")


def waiting(spark: SparkSession, checkpoint: str, labels: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """The rates of the samples that a stopped counter_rate query still held back, from the state in its checkpoint: with what the query has brought out
    these are the rates of all samples. The state stays as it is."""
    state = spark.read.format("statestore").load(checkpoint).select("key.*", "value.groupState.*")
    passed = F.when(F.col("at").isNotNull(), F.array(F.struct(F.col("at").alias("t"), F.col("value").alias("v")))).otherwise(F.array().cast("array<struct<t:bigint,v:double>>"))
    held = F.zip_with("times", "values", lambda t, v: F.struct(t.alias("t"), v.alias("v")))
    rows = state.select(*labels, F.explode(F.concat(passed, held)).alias("s"))
    samples = rows.select(*labels, F.timestamp_micros("s.t").alias(time), F.col("s.v").alias(value))
    return reports.counter_rate(samples, labels, time, value).select(*labels, time, value, "rate")
