import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import coerce, paths
from millrace.functions.coerce import misfits
from millrace.operators import reports, sinks
from millrace.operators import transforms as t
from millrace.plans import pipeline
from millrace.sources import readers
from millrace.streaming import runner

END = {"type": "kafka", "kafka": {"brokers": ["b"], "topic": "t"}}
SPEC = {
    "source": END, "sink": END, "errors": {"type": "trino", "trino": {"serverURL": "u", "catalog": "c", "schema": "s", "table": "t"}},
    "transformations": [{"type": "filter", "filter": {"condition": "ok"}}, {"type": "mask", "mask": {"fields": ["pw"]}}, {"type": "router", "router": {"routes": [{"condition": "type == 'a'", "sink": END}]}}, {"type": "remove", "remove": {"fields": ["ok"]}}],
}


@pytest.mark.parametrize(
    "change, word",
    [({"source": None}, "source.type"), ({"source": {"type": "x"}}, "one of"), ({"sink": {"type": "kafka", "kafka": {"brokers": ["b"]}}}, "topic"), ({"sink": {"type": "postgresql", "postgresql": {"connectionString": "c"}}}, "table"), ({"errors": {"type": "trino"}}, "trino"),
     ({"transformations": [{"type": "flatten", "flatten": {}}]}, "field"), ({"transformations": [{"type": "mask"}]}, "fields"), ({"transformations": [{"type": "nope"}]}, "unknown"), ({"transformations": [{"type": "router", "router": {"routes": [{"condition": ""}]}}]}, "condition"), ({"transformations": [{}]}, "type")],
)
def test_bad_specs(change, word):
    with pytest.raises(ValueError, match=word):
        pipeline.compile_flow(SPEC | change)


def test_custom_steps_and_empty_routes():
    t.register("double", lambda: lambda df: df.union(df))
    flow = pipeline.compile_flow(SPEC | {"transformations": [{"type": "double"}, {"type": "router", "router": {"routes": []}}]})
    assert len(flow.steps) == 2 and flow.routes == {}


def test_stream_routes_errors_and_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"ok": 1, "type": "a", "pw": "x"}, {"ok": True, "type": "b"}, {"ok": 0, "type": "a"}]
    (source / "1.txt").write_text("\n".join(map(json.dumps, lines)))
    spec = SPEC | {"transformations": SPEC["transformations"][1:]}
    flow = pipeline.compile_flow(spec)
    to = lambda n: lambda df: df.select("value").write.mode("append").text(str(tmp_path / n))
    read = lambda n: sorted(json.loads(p)["type"] if "type" in p else p for p in [r.value for r in spark.read.text(str(tmp_path / n)).collect()])
    for _ in range(2):
        messages = readers.read_files(spark, str(source), "text", stream=True)
        query = runner.start(flow, messages, str(tmp_path / "cp"), to("default"), {"type == 'a'": to("a")}, to("errors"))
        query.awaitTermination()
        (source / "2.txt").write_text('broken\n{"type":"a","ok":2}')
    assert read("a") == ["a", "a", "a"] and read("default") == ["b"]
    (envelope,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "errors")).collect()]
    assert envelope["original_message"] == {"original_data": "broken"} and envelope["error"]["message"] == "not a JSON object" and envelope["error"]["original_sink"] == "kafka"


@pytest.mark.parametrize(
    "document, target, want",
    [(2.5, "bigint", 2), (3.5, "integer", 4), ("x", "bigint", 0), (True, "int", 0), ([1], "smallint", 0), (1.5, "double", 1.5), ("1", "real", 0.0), (True, "boolean", True), (1, "boolean", False), (42, "varchar(5)", "42"), (True, "varchar", "true"), ({"a": 1}, "varchar", '{"a":1}'), (None, "bigint", None), (None, "varchar", None),
     ("2026-01-16T13:55:03+08:00", "timestamp", "2026-01-16 05:55:03"), ("2026-01-16T13:55:03Z", "timestamp(6) with time zone", "2026-01-16 13:55:03"), (1705390503, "timestamp", "2024-01-16 07:35:03"), (1705390503000, "timestamp", "2024-01-16 07:35:03"), ("2026-01-16", "date", "2026-01-16")],
)
def test_coercion(spark, document, target, want):
    df = paths.parse_body(spark.createDataFrame([(json.dumps({"v": document}),)], "value string"))
    got = coerce.align(df, [("v", target), ("w", "bigint")]).select(F.col("v").cast("string") if "time" in target or target == "date" else "v", "w").first()
    assert got[0] == want and got[1] is None


def test_write_semantics(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, n string, v double")
    new = spark.createDataFrame([(2, "c", 5.0, 1), (3, "d", 6.0, 2), (3, "e", 7.0, 3)], "id int, n string, v double, at int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.insert_ignore(old, new, ["id"], [F.col("at")])) == [(1, "a", 1.0), (2, "b", 2.0), (3, "d", 6.0)]
    assert rows(sinks.upsert(old, new, ["id"], [F.col("at")])) == [(1, "a", 1.0), (2, "c", 5.0), (3, "e", 7.0)]
    assert rows(sinks.upsert(old, new.drop("v"), ["id"], [F.col("at")]))[1] == (2, "c", 2.0)
    assert rows(sinks.upsert_present(old, new.withColumn("n", F.lit(None).cast("string")), ["id"], [F.col("at")]))[1] == (2, "b", 5.0)


def test_retry():
    calls, waits = [], []

    def failing(text, times):
        def run():
            calls.append(1)
            if len(calls) <= times:
                raise RuntimeError(text)

        return run

    sinks.with_retry(failing("i/o Timeout", 2), sleep=waits.append)
    assert waits == [0.5, 1.0] and len(calls) == 3
    for text, patterns in (("syntax error", sinks.TIMEOUTS), ("connection refused", sinks.TIMEOUTS)):
        calls.clear()
        with pytest.raises(RuntimeError):
            sinks.with_retry(failing(text, 9), patterns=patterns, sleep=waits.append)
        assert len(calls) == 1
    for text in ("Query failed: TOO_MANY_REQUESTS_FAILED", "Transient failure", "Worker node 3 crashed", "please retry your query", "Too many errors", "Connect timeout", "server is under too much load", "The node may have crashed"):
        assert sinks.passing(RuntimeError(text), sinks.POLICIES["trino"][2]), text
    for text in ("too_many_requests_failed", "connection refused", "broken pipe", "bad gateway", "syntax error"):
        assert not sinks.passing(RuntimeError(text), sinks.POLICIES["trino"][2]), text
    assert sinks.passing(TimeoutError()) and sinks.passing(RuntimeError("context deadline exceeded"))


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(i, f"test{i}", 100 * i) for i in (1, 2, 3)], "id int, name string, val int")
    sinks.write_jdbc(df, url, "items")
    source = readers.Incremental(readers.jdbc_table(spark, url, "items"), "ID") if "ID" in readers.jdbc_table(spark, url, "items")().columns else readers.Incremental(readers.jdbc_table(spark, url, "items"))
    first = source.read()
    mark = source.next_mark(first)
    assert first.count() == 3 and mark == 3
    sinks.write_jdbc(spark.createDataFrame([(4, "test4", 400)], "id int, name string, val int"), url, "items")
    later = source.read(mark)
    assert [r[0] for r in later.collect()] == [4] and source.next_mark(source.read(4), 4) == 4
    assert readers.jdbc_query(spark, url, 'SELECT count(*) AS n FROM items').first()[0] == 4


def test_sources(spark):
    options = readers.kafka_options(["a:1", "b:2"], "t", sasl={"mechanism": "scram-sha-256", "username": "u", "password": "p"}, tls={"truststore.location": "x"})
    assert options["kafka.bootstrap.servers"] == "a:1,b:2" and options["startingOffsets"] == "earliest" and options["kafka.security.protocol"] == "SASL_SSL" and "Scram" in options["kafka.sasl.jaas.config"]
    records = spark.sql("SELECT binary('v') AS value, binary('k') AS key, 't' AS topic, 1 AS partition, 5L AS offset, current_timestamp() AS timestamp")
    assert readers.from_kafka(records).select("meta").first()[0] == {"topic": "t", "partition": "1", "offset": "5", "key": "k"}
    frames = spark.createDataFrame([(b"\x00\x00\x00\x01\x02rec",), (b"raw",), (b"\x00\x00\x00\x00\x01",)], "v binary").select(readers.split_frame(F.col("v")).alias("f")).select("f.*").collect()
    assert [(r.framed, r.schema_id, bytes(r.payload)) for r in frames] == [(True, 258, b"rec"), (False, None, b"raw"), (False, None, b"\x00\x00\x00\x00\x01")]
    odd = spark.createDataFrame([(b"\x00\x00\x00\x01\x02rec",), (b"\x00\x00\x00\x00\x07rec",), (b"raw",), (None,), (b"\x00\xff\xff\xff\xffrec",)], "value binary")
    assert [r.error for r in readers.undecoded(odd, [258]).collect()] == ["unknown schema id 7", "no frame", "no value", "unknown schema id out of range"]
    assert readers.undecoded(odd, []).count() == 5 and readers.undecoded(odd.limit(0), [258]).count() == 0
    messages = readers.to_messages(spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS x"), "t").first()
    assert json.loads(messages.value) == {"id": 1, "x": None} and messages.meta == {"table": "t", "id": "1"}


def test_reports(spark):
    hist = reports.histogram(spark.createDataFrame([(v,) for v in (0.0005, 0.0015, 0.003, 9.0)], "v double"), F.col("v"), "processing", [])
    assert [r.n for r in hist.orderBy("le").collect()][:4] == [1, 2, 3, 3] and hist.count() == 11
    assert reports.histogram_quantile(hist, 0.5, []).first()[0] == pytest.approx(0.002)
    assert reports.histogram_quantile(hist, 0.99, []).first()[0] == pytest.approx(0.512)
    rate = reports.counter_rate(spark.sql("SELECT timestamp_seconds(s) AS ts, v AS value FROM VALUES (0, 5), (10, 25), (20, 3) AS t(s, v)"), [])
    assert [r.rate for r in rate.orderBy("ts").collect()] == [2.0, 0.3]
    ids = spark.createDataFrame([({"message_id": "m", "id": "i"},), ({"id": "i"},), ({"partition": "1", "offset": "2"},), ({"kafka_offset": "9"},), ({},)], "m map<string,string>")
    assert [r[0] for r in ids.select(reports.message_id(F.col("m"))).collect()] == ["m", "i", "1/2", "9", ""]
    assert reports.step_counts(spark.range(10), [lambda d: d.where("id > 3"), lambda d: d.union(d)]) == [(10, 6), (6, 12)]


def test_bounded_incremental_read_and_stored_mark(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "id long, name string")
    stored, table, got = str(tmp_path / "mark"), [rows.where("id < 6")], []
    source = readers.Incremental(lambda: table[0])
    write = lambda df: got.append(sorted(r.id for r in df.collect()))
    assert source.deliver(write, stored) == 5
    table[0] = rows
    new, upper = source.advance(5)
    table[0] = rows.union(spark.createDataFrame([(99, "late")], rows.schema))
    assert upper == 9 and sorted(r.id for r in new.collect()) == [6, 7, 8, 9], "rows that arrive meanwhile are left to the next call"

    def broken(_):
        raise RuntimeError("sink down")

    with pytest.raises(RuntimeError):
        source.deliver(broken, stored)
    assert source.deliver(write, stored) == 99 and source.deliver(write, stored) == 99 and got == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 99]]


def test_merge_into_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = lambda *r: spark.createDataFrame(list(r), '"ID" long, "NAME" string, n int'.replace('"', ""))
    sinks.write_jdbc(rows((1, "a", 1), (2, "b", 2)), url, "target")
    order = [F.col("n")]
    sinks.merge_jdbc(rows((2, "x", 8), (2, "y", 9), (3, "c", 3)), url, "target", ["ID"], order)
    read = lambda: sorted(map(tuple, spark.read.format("jdbc").options(url=url, dbtable="target").load().collect()))
    assert read() == [(1, "a", 1), (2, "y", 9), (3, "c", 3)]
    sinks.merge_jdbc(rows((3, "z", 7), (4, "first", 1), (4, "second", 2)), url, "target", ["ID"], order, update=False)
    assert read() == [(1, "a", 1), (2, "y", 9), (3, "c", 3), (4, "first", 1)]
    sinks.merge_jdbc(rows((1, "new", 5)).select("ID", "n"), url, "target", ["ID"], [F.col("n")])
    assert read()[0] == (1, "a", 5), "columns that are not brought stay"
    assert sinks.merge_statement("t", "s", ["id", "v"], ["id"], True, "postgresql") == "INSERT INTO t (id, v) SELECT s.id, s.v FROM s s ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v"


def test_sinks_are_retried_alone_and_guarded(spark, tmp_path):
    calls = []
    run = runner.guarded(spark, str(tmp_path / "done"), 7, wait=0.0)

    def shaky():
        calls.append("shaky")
        if calls.count("shaky") < 2:
            raise RuntimeError("i/o timeout")

    for _ in range(2):
        run("first", lambda: calls.append("first"))
        run("shaky", shaky)
    assert calls == ["first", "shaky", "shaky"]
    runner.guarded(spark, str(tmp_path / "done"), 8)("first", lambda: calls.append("again"))
    assert calls[-1] == "again"
    assert sinks.passing(RuntimeError("Worker node 3 crashed"), sinks.POLICIES["trino"][2]) and not sinks.passing(RuntimeError("syntax error"), sinks.POLICIES["trino"][2])


def test_bad_numbers_go_to_the_error_sink(spark):
    flow = pipeline.compile_flow({"source": {"type": "kafka", "kafka": {"brokers": ["b"], "topic": "t"}}, "sink": {"type": "trino", "trino": {"serverURL": "u", "catalog": "c", "schema": "s", "table": "t"}}})
    messages = spark.createDataFrame([('{"id":1,"n":5}',), ('{"id":2,"n":30000000000}',), ('{"n":1}',), ("text",)], "value string")
    good, bad = [], []
    flow.write_batch(flow.plan(messages), {}, lambda df: good.extend(r.value for r in df.collect()), lambda df: bad.extend(json.loads(r.value)["error"]["message"] for r in df.collect()), target=[("id", "bigint"), ("n", "int")], required=("id",))
    assert [json.loads(v) for v in good] == [{"id": 1, "n": 5}] and sorted(bad) == ["id is missing", "n is out of range for int", "not a JSON object"]


def test_step_counts_and_totals(spark):
    df = spark.range(10)
    assert reports.step_counts(df, [lambda d: d.where("id > 2"), lambda d: d.where("id < 8")]) == [(10, 7), (7, 5)]
    assert tuple(reports.run_totals(df, F.col("id") % 4 == 0).first()) == (10, 3)


def test_a_chain_parses_its_text_at_most_twice(spark):
    """Once for the rows and once for the filter, which is pushed below; no step mentions the parsing again."""
    df = spark.createDataFrame([('{"a":{"b":1},"c":2,"d":"x"}',)], "value string")
    flow = t.chain([t.filter_rows("a.b == '1'"), t.mask(["d", "c"], keep_length=True), t.timestamp("at.time"), t.remove(["c"]), t.select(["$.a.b", "d", "at", "a"])])
    out = paths.render_body(flow(paths.parse_body(df)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 2
    got = json.loads(out.select("value").first().value)
    assert got["b"] == 1 and got["d"] == "*" and set(got["at"]) == {"time"} and got["a"] == {"b": 1}


def test_checks_parse_a_body_once_however_often_they_mention_it(spark):
    """Filters on the reason stay above it; pushed below, they put the parsing in every place where a check mentions a value."""
    text = ['{"type":"a","amount":7.0,"at":"2024-01-01T00:00:00Z"}', '{"type":"a","amount":3e10,"at":"soon"}', '{"type":"a","at":"soon"}', '{"amount":"x"}', '{"type":null,"amount":1}']
    df = paths.parse_body(spark.createDataFrame([(i, v) for i, v in enumerate(text)], "id int, value string"))
    good, bad = sinks.split_bad(df, misfits(df, [("type", "varchar"), ("amount", "int"), ("at", "timestamp")], ("type",)))
    for part in (good.select("id"), bad.select("id", "reason")):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r.id for r in good.collect()] == [0]
    assert {r.id: r.reason for r in bad.collect()} == {1: "amount is out of range for int", 2: "at is out of form for timestamp", 3: "type is missing", 4: "type is missing"}
