import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from millrace.operators import reports
from millrace.streaming import rates

START, SCHEMA = datetime(2024, 5, 1, tzinfo=timezone.utc), "shard long, kind string, ts timestamp, value long"
LABELS = ["shard", "kind"]


def feed(spark, folder, batches, **options):
    """Run a query over some batches, one after the other and each with a query of its own; the rows that came out."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        samples = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        out = rates.counter_rate(samples, LABELS, **options)
        query = out.writeStream.format("parquet").options(path=f"{folder}/out", checkpointLocation=f"{folder}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def at(seconds):
    return START + timedelta(seconds=seconds)


def as_set(df):
    return sorted((str(r.shard), str(r.kind), r.ts, r.value, round(r.rate, 9)) for r in df.collect())


def test_a_stream_has_the_rates_of_the_batch_form(spark, tmp_path):
    """Samples out of order within the delay, restarts of counters, ties, nulls, and a query that starts again for every batch."""
    pick = random.Random(5)
    rows = [(pick.choice([1, 2, None]), pick.choice(["a", None]), at(i + pick.random()), pick.randrange(50)) for i in range(300)]
    rows += [(1, "a", at(40), 7), (1, "a", at(40), 9), (1, "a", None, 3), (2, "a", at(41), None)]
    rows.sort(key=lambda r: (r[2] or at(0)) + timedelta(seconds=pick.uniform(-8, 8)))
    out = feed(spark, tmp_path, [rows[:90], rows[90:150], rows[150:]], delay="20 seconds")
    want = reports.counter_rate(spark.createDataFrame(rows, SCHEMA), LABELS)
    passed = out.agg(F.max("ts")).first()[0]
    assert passed < datetime(2024, 5, 1, 0, 4, 50) and as_set(out) == as_set(want.where(F.col("ts") <= F.lit(passed)))
    left = rates.waiting(spark, f"{tmp_path}/checkpoint", LABELS)
    assert as_set(out.unionByName(left)) == as_set(want)


def test_late_samples_and_series_that_fell_silent(spark, tmp_path):
    a, b = (1, "a"), (2, "b")
    batches = [
        [(*a, at(0), 10), (*b, at(0), 1), (*a, at(10), 30)],
        [(*a, at(100), 120)],  # the watermark comes to 90: what waited comes out by timers, b is silent for more than 60 s
        [(*a, at(50), 60), (*a, at(95), 110), (*b, at(101), 500), (*b, at(111), 520)],  # at 50 too late, at 95 not
        [(*a, at(200), 20)],
        [(*a, at(300), 30)],
    ]
    out = feed(spark, tmp_path, batches, delay="10 seconds", idle=60)
    assert as_set(out) == sorted([("1", "a", *x) for x in ((datetime(2024, 5, 1, 0, 0, 10), 30, 2.0), (datetime(2024, 5, 1, 0, 1, 35), 110, round(80 / 85, 9)), (datetime(2024, 5, 1, 0, 1, 40), 120, 2.0), (datetime(2024, 5, 1, 0, 3, 20), 20, 0.2))] + [("2", "b", datetime(2024, 5, 1, 0, 1, 51), 520, 2.0)])
    held = spark.read.format("statestore").load(f"{tmp_path}/checkpoint").select("key.shard").collect()
    assert [r.shard for r in held] == [1], "b is forgotten"
    empty = feed(spark, tmp_path / "none", [[]])
    assert empty.count() == 0 and empty.columns == [*LABELS, "ts", "value", "rate"]
