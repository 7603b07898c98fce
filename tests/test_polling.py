import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from derby import Derby
from millrace.operators import sinks
from millrace.sources import polling


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"name {i}") for i in ids], '`ID` long, `NAME` string')


def run(df, checkpoint, got, fail_at=None):
    """Process what is there, as (batch, sorted ids) in got."""

    def batch(b, n):
        if n == fail_at:
            raise RuntimeError("sink down")
        got.append((n, sorted(r[0] for r in b.collect())))

    query = df.writeStream.foreachBatch(batch).option("checkpointLocation", str(checkpoint)).trigger(processingTime="100 milliseconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_database_table_is_read_on_from_the_checkpoint(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sinks.write_jdbc(rows(spark, *range(1, 26)), url, "items")
    table = polling.DatabaseTable(Derby(spark, url), "items", "ID")
    open_ = lambda **o: polling.poll(spark, table, "`ID` long, `NAME` string", tasks=3, **o)
    got = []
    run(open_(max_rows=10), tmp_path / "cp", got)
    assert got == [(0, [*range(1, 11)]), (1, [*range(11, 21)]), (2, [*range(21, 26)])]
    # a query that starts again reads on: nothing twice, nothing lost, and limited as before
    sinks.write_jdbc(rows(spark, *range(30, 45)), url, "items")
    got.clear()
    run(open_(max_rows=10), tmp_path / "cp", got)
    assert got == [(3, [*range(30, 40)]), (4, [*range(40, 45)])]
    # a batch that failed comes again with the same rows, though others have arrived
    sinks.write_jdbc(rows(spark, 50, 51), url, "items")
    got.clear()
    with pytest.raises(Exception, match="sink down"):
        run(open_(max_rows=10), tmp_path / "cp", got, fail_at=5)
    sinks.write_jdbc(rows(spark, 52), url, "items")
    run(open_(max_rows=10), tmp_path / "cp", got)
    assert got == [(5, [50, 51]), (6, [52])]
    # available now: one batch, then the end
    sinks.write_jdbc(rows(spark, 60), url, "items")
    got.clear()
    query = open_().writeStream.foreachBatch(lambda b, n: got.append(sorted(r[0] for r in b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert got == [[60]]


def test_times_as_marks(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    made = rows(spark, *range(20)).select(F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("ID") / 2).cast("long")).alias("CREATED_AT"), F.col("NAME"))
    sinks.write_jdbc(made, url, "items")
    df = polling.poll(spark, polling.DatabaseTable(Derby(spark, url), "items", "CREATED_AT"), "`CREATED_AT` timestamp, `NAME` string", max_rows=5)
    got = []
    run(df.select("NAME"), tmp_path / "cp", got)
    assert sorted(x for _, names in got for x in names) == sorted(f"name {i}" for i in range(20))
    assert [len(names) for _, names in got] == [6, 6, 6, 2], "rows of the last moment come whole"


def test_few_rows_wait_for_more_or_for_their_age():
    class Growing:
        marks = []

        def next_mark(self, low, limit):
            left = [m for m in self.marks if low is None or m > low][:limit]
            return (left[-1], len(left)) if left else (None, 0)

    table = Growing()
    reader = polling.PolledReader(table, [], 4, 10, 5, 0.3)
    assert reader.latestOffset() == {"mark": None}
    table.marks = [1, 2, 3]
    assert reader.latestOffset() == {"mark": None}
    table.marks = [1, 2, 3, 4, 5, 6]
    assert reader.latestOffset() == {"mark": 6}, "enough rows"
    table.marks += [7]
    assert reader.latestOffset() == {"mark": 6}
    time.sleep(0.35)
    assert reader.latestOffset() == {"mark": 7}, "old enough"
    table.marks += range(8, 40)
    assert reader.latestOffset() == {"mark": 17}, "no more than the limit"


def test_ranges_hold_every_mark_once():
    rng = random.Random(1)
    for _ in range(200):
        low, width, n = rng.randint(-50, 50), rng.randint(1, 40), rng.randint(1, 9)
        parts = polling.ranges(low, low + width, n)
        assert [m for p in parts for m in range(p.low + 1, p.high + 1)] == [*range(low + 1, low + width + 1)] and len(parts) <= n
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 3)
    parts = polling.ranges(a, b, 4)
    assert len(parts) == 4 and parts[0].low == a and parts[-1].high == b and all(x.high == y.low for x, y in zip(parts, parts[1:]))
    assert polling.ranges("a", "b", 4) == [polling.Range("a", "b")]


def test_a_folder_of_files_that_grows(spark, tmp_path):
    folder, got = str(tmp_path / "t"), []
    write = lambda ids: rows(spark, *ids).repartition(3).write.mode("append").parquet(folder)
    write(range(100))
    table = polling.ParquetTable(folder, "ID")
    run(polling.poll(spark, table, "`ID` long, `NAME` string", max_rows=40), tmp_path / "cp", got)
    write(range(200, 230))
    run(polling.poll(spark, table, "`ID` long, `NAME` string", max_rows=40), tmp_path / "cp", got)
    assert [ids for _, ids in got] == [[*range(40)], [*range(40, 80)], [*range(80, 100)], [*range(200, 230)]]
    assert table.next_mark(229, 5) == (None, 0) and table.next_mark(None, None) == (229, 130) and table.first_mark(229) == 0
