import json
import time

import pytest
from pyspark.sql import functions as F

from derby import Derby, refused
from millrace.operators import database, sinks
from millrace.plans import pipeline
from millrace.sources import readers
from millrace.streaming import runner

KAFKA = {"type": "kafka", "kafka": {"brokers": ["b"], "topic": "t"}}
TRINO = {"type": "trino", "trino": {"serverURL": "u", "catalog": "c", "schema": "s", "table": "t"}}
ROUTES = {"type": "router", "router": {"routes": [{"condition": "to == 'a'", "sink": KAFKA}, {"condition": "to == 'b'", "sink": TRINO}]}}


def test_slow_sinks_overlap_and_a_failing_one_stops_no_other(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("d", 5)], "route string, v int")
    spans, seen, pools = {}, {}, {}

    def sink(name, error=None):
        def write(part):
            began = time.monotonic()
            pools[name] = part.sparkSession.sparkContext.getLocalProperty("spark.scheduler.pool")
            seen[name] = sorted(r.v for r in part.collect())
            time.sleep(0.8)
            spans[name] = (began, time.monotonic())
            if error:
                raise RuntimeError(error)
            return name

        return write

    assert sinks.fan_out(df, {"a": sink("a"), "b": sink("b")}, sink("rest")) == {"a": "a", "b": "b", "default": "rest"}
    assert seen == {"a": [1], "b": [2], "rest": [3, 4, 5]} and pools == {"a": "sink a", "b": "sink b", "rest": "sink default"}
    assert max(s for s, _ in spans.values()) < min(e for _, e in spans.values()), "all at once"
    seen.clear()
    with pytest.raises(RuntimeError, match="^b is down$"):
        sinks.fan_out(df, {"a": sink("a"), "b": sink("b", "b is down")}, sink("rest"))
    assert set(seen) == {"a", "b", "rest"}
    with pytest.raises(sinks.SinksFailed) as caught:
        sinks.fan_out(df, {"a": sink("a", "one"), "b": sink("b", "two")}, sink("rest"), threads=1)
    assert set(caught.value.failures) == {"a", "b"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_policies_follow_the_kind_of_sink():
    flow = pipeline.compile_flow({"source": KAFKA, "sink": KAFKA, "errors": TRINO, "transformations": [ROUTES]})
    assert [flow.policy(n)[0] for n in ("default", "to == 'a'", "to == 'b'", "errors", "errors of default")] == [3, 3, 5, 5, 5]
    assert pipeline.compile_flow({"source": KAFKA, "sink": TRINO}).policy("default") == (5, 2.0, sinks.TIMEOUTS + sinks.TRANSIENT)


def test_totals_go_on_after_a_restart(spark, tmp_path):
    flow = pipeline.compile_flow({"source": KAFKA, "sink": KAFKA, "errors": KAFKA, "transformations": [ROUTES]})
    (tmp_path / "in").mkdir()
    failing, tries = [True], []

    def shaky(df):
        tries.append(1)
        if failing[0]:
            raise RuntimeError("i/o timeout" if len(tries) < 3 else "disk full")

    def once(n, lines):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(lines))
        messages = readers.read_files(spark, str(tmp_path / "in"), "text", stream=True)
        return runner.start(flow, messages, str(tmp_path / "cp"), lambda df: df.count(), {"to == 'a'": shaky}, lambda df: df.count(), target=[("n", "int")])

    ok = lambda n: json.dumps({"n": n, "to": "a"})
    with pytest.raises(Exception, match="disk full"):
        once(1, [ok(1), ok(2), "broken", json.dumps({"n": 3e12})]).awaitTermination()
    assert len(tries) == 3, "a timeout is tried again, other failures are not"
    failing[0] = False
    once(2, [ok(3)]).awaitTermination()
    once(3, [ok(4), "[]", ok(5)]).awaitTermination()
    assert runner.Totals(spark, str(tmp_path / "cp")).read() == (5, 3)
    assert len([p for p in (tmp_path / "cp" / "totals").iterdir() if not p.name.endswith(".crc")]) <= 2
    marks = [p.name for p in (tmp_path / "cp" / "sinks").iterdir()]
    assert len(marks) == 1, "marks of earlier batches are gone"
    totals = runner.Totals(spark, str(tmp_path / "other"))
    for batch, add in ((0, (5, 1)), (1, (2, 0)), (1, (3, 0)), (2, (1, 1))):  # batch 1 comes twice
        totals.add(batch, *add)
    assert totals.read() == (9, 2) and totals.read(2) == (8, 1)


def test_rows_that_the_database_refuses_go_to_the_error_sink(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    with database.Database(url).transaction(spark) as connection:
        database.run(connection, "CREATE TABLE items (n INT PRIMARY KEY CHECK (n < 100))")
    flow = pipeline.compile_flow({"source": KAFKA, "sink": TRINO, "errors": KAFKA})
    connect, bad = Derby(spark, url), []

    def writer(df):
        rows = df.select(F.get_json_object("value", "$.n").cast("int").alias("N"), "value")
        return database.write_isolated(rows, connect, "items", str(tmp_path / "refused"), refused=refused, carry=("value",))

    messages = spark.createDataFrame([(json.dumps({"n": n}),) for n in (1, 2, 2, 500, 3)] + [("text",)], "value string")
    counted = flow.write_batch(flow.plan(messages), {}, writer, lambda df: bad.extend(json.loads(r.value) for r in df.collect()))
    assert counted == (3, 3)
    assert sorted(str(b["original_message"]) for b in bad) == ["{'n': 2}", "{'n': 500}", "{'original_data': 'text'}"] and all(b["error"]["message"] for b in bad)
    assert sorted(r[0] for r in spark.read.format("jdbc").options(url=url, dbtable="items").load().collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError, match="refused rows"):
        flow.write_batch(flow.plan(messages.limit(1)), {}, lambda df: df.withColumn("reason", F.lit("no")), None)
