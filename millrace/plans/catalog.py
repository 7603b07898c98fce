"""Registered queries over the standard tables and their equivalents in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import coerce as co
from millrace.functions import names, paths, predicates
from millrace.operators import reports, sinks
from millrace.operators import transforms as t
from millrace.sources import polling, readers
from millrace.streaming import rates
from millrace.streaming.shared import shared_folder

FLAGSHIP = "filter_mask_select_events"
NOW = "2026-01-16 05:55:03"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES


def _query(name: str, sql: str | None = None):
    def add(function):
        _QUERIES[name] = function
        if sql:
            _ORACLES[name] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    """Events as messages: the whole row as the JSON value, dynamic lane."""
    e = _table(spark, sf_dir, "events")
    value = F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("type"), F.col("value").alias("amount"), F.from_json("props", "k bigint").alias("props"), F.array("event_type", F.lit("x")).alias("tags")))
    return paths.parse_body(e.select("event_id", value.alias("value")))


def _at(path: str, kind: str):
    return paths.variant_at(F.col("body"), path).try_cast(kind)


@_query(FLAGSHIP, "SELECT event_id, 'yes' AS has_k, '***' AS masked FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 0")
def _(spark, sf_dir):
    flow = t.chain([t.filter_rows("props.k"), t.mask(["type"]), t.select(["event_id", "$.type"])])
    return flow(_events(spark, sf_dir)).select(_at("event_id", "bigint").alias("event_id"), F.lit("yes").alias("has_k"), _at("type", "string").alias("masked"))


@_query("filter_truthy_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 0")
def _(spark, sf_dir):
    df = paths.parse_body(_table(spark, sf_dir, "events"), "props")
    return t.filter_rows("$.k")(df).select("event_id", _at("k", "bigint").alias("k"))


@_query(
    "filter_truthy_types",
    "SELECT doc_id, quality IS NOT NULL AND quality <> 0 AS number_ok, lang <> 'en' AS flag_ok, (CASE WHEN lang = 'en' THEN 'false' WHEN lang = 'de' THEN '' ELSE lang END) NOT IN ('', 'false') AS text_ok, true AS object_ok, false AS null_ok FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    text = F.when(F.col("lang") == "en", "false").when(F.col("lang") == "de", "").otherwise(F.col("lang"))
    d = d.select("doc_id", "quality", (F.col("lang") != "en").alias("flag"), text.alias("text"), F.struct("lang").alias("object"), F.lit(None).cast("int").alias("nothing"))
    conditions = {"number_ok": "quality", "flag_ok": "flag", "text_ok": "text", "object_ok": "object", "null_ok": "nothing"}
    return d.select("doc_id", *[predicates.condition(d, c).alias(n) for n, c in conditions.items()])


@_query(
    "equality_text_form",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) = 7 AS number_is, event_type = 'view' AS text_is, event_type = 'click' AS quoted_is, false AS unquoted FROM events",
)
def _(spark, sf_dir):
    e = _events(spark, sf_dir)
    conditions = {"number_is": "props.k == '7'", "text_is": "$.type == 'view'", "quoted_is": 'type=="click"', "unquoted": "type == view"}
    return e.select("event_id", *[predicates.condition(e, c).alias(n) for n, c in conditions.items()])


@_query(
    "exists_null_and_missing",
    "SELECT event_id, true AS has_null, false AS has_missing, true AS has_nested, false AS truthy_null, 2::BIGINT AS n_tags, event_type AS first_tag FROM events",
)
def _(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("body", F.map_concat("body", F.create_map(F.lit("nothing"), F.parse_json(F.lit("null")))))
    b = F.col("body")
    return e.select(
        "event_id", paths.variant_exists(b, "nothing").alias("has_null"), paths.variant_exists(b, "gone").alias("has_missing"), paths.variant_exists(b, "props.k").alias("has_nested"), predicates.condition(e, "nothing").alias("truthy_null"),
        paths.variant_at(b, "tags.#").cast("bigint").alias("n_tags"), paths.variant_at(b, "tags.0").cast("string").alias("first_tag"),
    )


@_query("json_validity", "SELECT doc_id, false AS text_valid, true AS object_valid FROM documents WHERE text IS NOT NULL AND NOT json_valid(text)")
def _(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", predicates.valid_json(F.col("text")).alias("text_valid"), predicates.valid_json(F.to_json(F.struct("doc_id"))).alias("object_valid")).where("NOT text_valid")


@_query(
    "json_validity_varied",
    "SELECT event_id, event_id % 8 IN (0, 2, 4) AS valid FROM events",
)
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    text = F.element_at(F.array(F.col("props"), F.concat("props", F.lit(" x")), F.lit("[1, 2]"), F.lit("1, 2"), F.concat(F.lit('"'), "event_type", F.lit('"')), F.concat("event_type", F.lit("1] garbage")), F.concat("props", F.lit("] x")), F.concat("props", F.lit("],[2"))), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select("event_id", predicates.valid_json(text).alias("valid"))


@_query("equality_typed_numbers", "SELECT o_orderkey, o_custkey % 7 = 5 AS whole, o_totalprice = 1.5 AS half, false AS unquoted FROM orders")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 7).cast("double").alias("rest"))
    return o.select("o_orderkey", predicates.condition(o, "rest == '5'").alias("whole"), predicates.condition(o, "o_totalprice == '1.5'").alias("half"), predicates.condition(o, "rest == 5").alias("unquoted"))


ROUTES = ["type == 'view'", "props.k", "type == 'error'"]


@_query(
    "router_first_match",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'type == ''view''' WHEN CAST(json_extract(props, '$.k') AS BIGINT) <> 0 THEN 'props.k' WHEN event_type = 'error' THEN 'type == ''error''' END AS route FROM events",
)
def _(spark, sf_dir):
    return t.router(ROUTES)(_events(spark, sf_dir)).select("event_id", "route")


@_query(
    "router_fanout_counts",
    "SELECT coalesce(route, 'default') AS route, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'type == ''view''' WHEN CAST(json_extract(props, '$.k') AS BIGINT) <> 0 THEN 'props.k' WHEN event_type = 'error' THEN 'type == ''error''' END AS route FROM events) GROUP BY 1",
)
def _(spark, sf_dir):
    return reports.counts(t.router(ROUTES)(_events(spark, sf_dir)).select(F.coalesce("route", F.lit("default")).alias("route")), ["route"])


@_query("select_fields", "SELECT event_id, user_id FROM events")
def _(spark, sf_dir):
    return t.select(["event_id", "$.user_id", "gone"])(_table(spark, sf_dir, "events"))


@_query("select_nested_last_segment", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 2::BIGINT AS n_keys FROM events")
def _(spark, sf_dir):
    return t.select(["event_id", "props.k", "gone.k"])(_events(spark, sf_dir)).select(_at("event_id", "bigint").alias("event_id"), _at("k", "bigint").alias("k"), F.size("body").cast("bigint").alias("n_keys"))


@_query("select_nothing_is_unchanged", "SELECT event_id, event_type AS type FROM events")
def _(spark, sf_dir):
    return t.select(["gone", "props.gone"])(_events(spark, sf_dir)).select("event_id", _at("type", "string").alias("type"))


@_query("remove_fields", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf_dir):
    return t.remove(["$.c_name", "c_acctbal", "gone"])(_table(spark, sf_dir, "customer"))


@_query("remove_nested", "SELECT n_nationkey, r_regionkey, false AS has_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    joined = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = paths.parse_body(joined.select(F.to_json(F.struct("n_nationkey", F.struct("r_regionkey", "r_name").alias("region"))).alias("value")))
    out = t.remove(["region.r_name", "region.gone"])(df)
    return out.select(_at("n_nationkey", "int").alias("n_nationkey"), _at("region.r_regionkey", "int").alias("r_regionkey"), paths.variant_exists(F.col("body"), "region.r_name").alias("has_name"))


@_query("remove_nested_typed", "SELECT n_nationkey, r_regionkey, 1::INT AS n_fields FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    joined = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = t.remove(["region.r_name"])(joined.select("n_nationkey", F.struct("r_regionkey", "r_name").alias("region")))
    return out.select("n_nationkey", "region.r_regionkey", F.lit(len(out.schema["region"].dataType.names)).alias("n_fields"))


@_query("mask_fixed", "SELECT c_custkey, '***' AS c_name, '###' AS c_mktsegment FROM customer")
def _(spark, sf_dir):
    df = t.chain([t.mask(["c_name", "gone"]), t.mask(["$.c_mktsegment"], "#")])(_table(spark, sf_dir, "customer"))
    return df.select("c_custkey", "c_name", "c_mktsegment")


@_query("mask_keep_length_bytes", "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, md5(repeat('*', strlen(text))) AS masked FROM documents WHERE text IS NOT NULL")
def _(spark, sf_dir):
    df = t.mask(["text"], keep_length=True)(_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return df.select("doc_id", F.length("text").cast("bigint").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("masked"))


@_query("mask_nested_numbers", "SELECT event_id, repeat('x', length(CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR))) AS k FROM events")
def _(spark, sf_dir):
    return t.mask(["props.k"], "x", True)(_events(spark, sf_dir)).select("event_id", _at("props.k", "string").alias("k"))


@_query(
    "flatten_objects",
    "SELECT l_orderkey, l_linenumber, l_quantity, 'line' AS kind FROM lineitem",
)
def _(spark, sf_dir):
    line = F.struct("l_linenumber", "l_quantity", F.lit("line").alias("kind"))
    nested = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines")).withColumn("kind", F.lit("order"))
    return t.flatten("lines")(nested).select("l_orderkey", "l_linenumber", "l_quantity", "kind")


@_query("flatten_objects_dynamic", "SELECT l_orderkey, l_linenumber, l_partkey, 'line' AS kind FROM lineitem")
def _(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", F.lit("line").alias("kind"))
    nested = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    df = paths.parse_body(nested.select(F.to_json(F.struct("l_orderkey", F.lit("order").alias("kind"), F.struct(F.col("lines").alias("array")).alias("lines"))).alias("value")))
    return t.flatten("$.lines")(df).select(_at("l_orderkey", "bigint").alias("l_orderkey"), _at("l_linenumber", "int").alias("l_linenumber"), _at("l_partkey", "bigint").alias("l_partkey"), _at("kind", "string").alias("kind"))


@_query("flatten_scalars", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def _(spark, sf_dir):
    return t.flatten("embedding")(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@_query(
    "flatten_empty_and_missing",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN x END AS n, o_orderkey % 3 = 2 AS kept FROM orders CROSS JOIN (VALUES (1), (2)) v(x) WHERE o_orderkey % 3 = 0 OR x = 1",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.to_json(F.struct(k, F.array(F.lit(1), F.lit(2)).alias("n")))).when(k % 3 == 1, F.to_json(F.struct(k, F.array().cast("array<int>").alias("n")))).otherwise(F.to_json(F.struct(k, F.lit("no array").alias("n"))))
    df = paths.parse_body(_table(spark, sf_dir, "orders").select(value.alias("value")))
    return t.flatten("n")(df).select(_at("o_orderkey", "bigint").alias("o_orderkey"), _at("n", "int").alias("n"), (F.coalesce(_at("n", "string"), F.lit("")) == "no array").alias("kept"))


@_query("snake_case_columns", "SELECT o_orderkey AS order_key, o_custkey AS xml_http_cust, o_orderstatus AS status FROM orders")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return t.snake_case()(o.select(F.col("o_orderkey").alias("orderKey"), F.col("o_custkey").alias("XMLHttpCust"), F.col("o_orderstatus").alias("Status")))


@_query("camel_case_columns", "SELECT o_orderkey AS \"OrderKey\", o_custkey AS \"CustKey2\", o_orderstatus AS \"Status\" FROM orders")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return t.camel_case()(o.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("_cust__key2"), F.col("o_orderstatus").alias("Status")))


@_query("case_names_deep", "SELECT o_orderkey, o_custkey AS inner_cust, o_orderstatus AS first_status, o_custkey AS pascal_cust FROM orders")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("custKey"), F.array(F.struct(F.col("o_orderstatus").alias("orderStatus"))).alias("allLines")).alias("outerPart"))
    deep = t.snake_case(True)(paths.parse_body(o.select("o_orderkey", F.to_json(F.struct("outerPart")).alias("value"))))
    pascal = t.camel_case(True)(deep.withColumn("snake", F.col("body")))
    b = F.col("snake")
    return pascal.select(
        "o_orderkey", paths.variant_at(b, "outer_part.cust_key").cast("bigint").alias("inner_cust"), paths.variant_at(b, "outer_part.all_lines.0.order_status").cast("string").alias("first_status"), _at("OuterPart.CustKey", "bigint").alias("pascal_cust")
    )


@_query(
    "case_names_values",
    "SELECT DISTINCT c_mktsegment, lower(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS snake, upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS pascal FROM customer",
)
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return c.select("c_mktsegment", names.snake(F.col("c_mktsegment")).alias("snake"), names.pascal(F.lower("c_mktsegment")).alias("pascal"))


@_query("timestamp_fixed_now", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(o_orderdate, '%d/%m/%y %H:%M') AS short FROM orders")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    out = t.chain([t.timestamp(now=F.col("o_orderdate")), t.timestamp("$.short", "02/01/06 15:04", F.col("o_orderdate"))])(o)
    return out.drop("o_orderdate")


@_query("chain_select_mask_timestamp", f"SELECT c_custkey AS id, repeat('*', strlen(c_name)) AS c_name, '{NOW[:10]}' AS seen FROM customer")
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    df = paths.parse_body(c.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")).alias("value")))
    out = t.chain([t.select(["id", "c_name"]), t.mask(["c_name"], keep_length=True), t.timestamp("seen", "2006-01-02", F.lit(NOW).cast("timestamp"))])(df)
    return out.select(_at("id", "bigint").alias("id"), _at("c_name", "string").alias("c_name"), _at("seen", "string").alias("seen"))


@_query("replace_field", "SELECT event_id AS id, user_id AS nested_user, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    out = t.rename_fields(["event_id:id", "user_id:who.user", "$.props.k:k", "gone:x"])(_events(spark, sf_dir))
    return out.select(_at("id", "bigint").alias("id"), _at("who.user", "bigint").alias("nested_user"), _at("k", "bigint").alias("k"))


@_query("header_from", "SELECT event_id, event_type AS kind, CASE WHEN event_type = 'view' THEN 'de' END AS lang FROM events")
def _(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("headers", F.array(F.struct(F.lit("X-Kind").alias("key"), _at("type", "string").cast("binary").alias("value")), F.struct(F.when(_at("type", "string") == "view", "X-Lang").otherwise("Other").alias("key"), F.lit("de").cast("binary").alias("value"))))
    out = t.header_from(["X-Kind:kind", "X-Lang:$.meta.lang", "X-Gone:gone"])(e)
    return out.select("event_id", _at("kind", "string").alias("kind"), _at("meta.lang", "string").alias("lang"))


@_query("incremental_by_id", "SELECT event_id, event_type FROM events WHERE event_id > 250")
def _(spark, sf_dir):
    return readers.Incremental(lambda: _table(spark, sf_dir, "events"), "event_id", "ts").read(250).select("event_id", "event_type")


@_query("incremental_by_created_at", "SELECT event_id, ts FROM events WHERE ts > (SELECT min(ts) + INTERVAL 1 DAY FROM events)")
def _(spark, sf_dir):
    source = readers.Incremental(lambda: _table(spark, sf_dir, "events"), None, "ts")
    first = source.open().agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("m")).first()[0]
    return source.read(first).select("event_id", "ts")


@_query("incremental_bounded", "SELECT event_id, event_type FROM events WHERE event_id > 250")
def _(spark, sf_dir):
    return readers.Incremental(lambda: _table(spark, sf_dir, "events"), "event_id", "ts").advance(250)[0].select("event_id", "event_type")


@_query("incremental_stream", "SELECT event_id, event_type, user_id FROM events")
def _(spark, sf_dir):
    """Events polled as a stream in batches of bounded size, by two queries with one checkpoint: the second reads on where the first ended."""
    table, folder = polling.ParquetTable(f"{sf_dir}/events.parquet", "event_id"), shared_folder(spark)
    for limit in (2_000, None):
        events = polling.poll(spark, table, "event_id long, event_type string, user_id long", max_rows=limit)
        query = events.writeStream.format("parquet").options(path=f"{folder}/rows", checkpointLocation=f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/rows")


_ORDERS_BY_SEGMENT = "SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"


@_query("custom_query_source", _ORDERS_BY_SEGMENT)
def _(spark, sf_dir):
    return readers.sql_query(spark, {n: _table(spark, sf_dir, n) for n in ("orders", "customer")}, _ORDERS_BY_SEGMENT)


def _halves(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 2 = 0 OR c_custkey % 5 = 0").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"), "c_custkey", F.concat("c_name", F.lit("-new")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = new.withColumn("c_name", F.concat("c_name", F.col("arrival").cast("string")))
    return c.where("c_custkey % 3 = 0"), new


@_query(
    "insert_ignore",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name || '-new1', c_acctbal + 1 FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 5 = 0) AND c_custkey % 3 <> 0",
)
def _(spark, sf_dir):
    target, new = _halves(spark, sf_dir)
    return sinks.insert_ignore(target, new, ["c_custkey"], [F.col("arrival")])


@_query(
    "upsert_latest",
    "SELECT c_custkey, c_name || CASE WHEN n THEN '-new2' ELSE '' END AS c_name, c_acctbal + CASE WHEN n THEN 1 ELSE 0 END AS c_acctbal FROM (SELECT *, c_custkey % 2 = 0 OR c_custkey % 5 = 0 AS n FROM customer) WHERE n OR c_custkey % 3 = 0",
)
def _(spark, sf_dir):
    target, new = _halves(spark, sf_dir)
    return sinks.upsert(target, new, ["c_custkey"], [F.col("arrival")])


@_query(
    "upsert_partial_columns",
    "SELECT c_custkey, c_name || CASE WHEN n THEN '-new2' ELSE '' END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS c_acctbal FROM (SELECT *, c_custkey % 2 = 0 OR c_custkey % 5 = 0 AS n FROM customer) WHERE n OR c_custkey % 3 = 0",
)
def _(spark, sf_dir):
    target, new = _halves(spark, sf_dir)
    return sinks.upsert(target, new.drop("c_acctbal"), ["c_custkey"], [F.col("arrival")])


@_query("align_columns", "SELECT event_id AS id, NULL::VARCHAR AS missing, event_type AS type, user_id AS \"user\" FROM events")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.lit(1).alias("extra"))
    return co.align(e, [("id", "bigint"), ("missing", "varchar"), ("type", "varchar(20)"), ("user", "bigint")])


@_query(
    "coerce_types",
    "SELECT event_id, user_id AS int_number, 0::BIGINT AS int_text, value AS real_number, 0::DOUBLE AS real_text, true AS flag, false AS flag_number, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS object_text, CAST(user_id AS VARCHAR) AS number_text FROM events",
)
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("user_id").alias("int_number"), F.col("event_type").alias("int_text"), F.col("value").alias("real_number"), F.col("event_type").alias("real_text"), F.lit(True).alias("flag"), F.col("user_id").alias("flag_number"), F.from_json("props", "k bigint").alias("object_text"), F.col("user_id").alias("number_text"), "event_id"))
    target = [("event_id", "bigint"), ("int_number", "bigint"), ("int_text", "bigint"), ("real_number", "double"), ("real_text", "double"), ("flag", "boolean"), ("flag_number", "boolean"), ("object_text", "varchar"), ("number_text", "varchar")]
    return co.align(paths.parse_body(e.select(body.alias("value"))), target)


@_query(
    "coerce_exact_numbers",
    "SELECT event_id, event_id + 9007199254740993 AS large, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS INT) END AS small, (CASE event_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 4 ELSE 2 END)::BIGINT AS rounded, CAST(event_id AS DECIMAL(20,2)) + 0.25 AS exact, NULL::TIMESTAMP AS missing FROM events",
)
def _(spark, sf_dir):
    k = F.col("event_id")
    text = F.format_string('{"event_id":%d,"large":%d,"small":%s,"rounded":%d.5,"exact":%d.25}', k, k + 9007199254740993, F.when(k % 2 == 0, (k % 100).cast("string")).otherwise("1e20"), k % 4, k)
    target = [("event_id", "bigint"), ("large", "bigint"), ("small", "integer"), ("rounded", "bigint"), ("exact", "numeric(20,2)"), ("missing", "timestamp(6) with time zone")]
    out = co.align(paths.parse_body(_table(spark, sf_dir, "events").select(text.alias("value"))), target)
    return out.withColumn("missing", F.col("missing").cast("timestamp_ntz"))


@_query(
    "misfit_rows",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'type is missing' WHEN event_id % 3 = 0 THEN 'amount is out of range for int' WHEN event_id % 7 = 0 THEN 'at is out of form for timestamp'
    WHEN event_id % 11 = 0 THEN 'day is out of form for date' END AS reason FROM events""",
)
def _(spark, sf_dir):
    k = F.col("event_id")
    e = _table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(k, F.when(k % 5 != 0, F.col("event_type")).alias("type"), F.when(k % 3 == 0, F.lit(3e10)).otherwise(F.lit(7.0)).alias("amount"), F.when(k % 7 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"), F.when(k % 11 == 0, F.lit("2024-99-99")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"))).alias("value"))
    df = paths.parse_body(e)
    good, bad = sinks.split_bad(df, co.misfits(df, [("type", "varchar"), ("amount", "int"), ("at", "timestamp"), ("day", "date")], ("type",)))
    return good.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", "reason"))


@_query(
    "coerce_timestamp",
    "SELECT o_orderkey, date_trunc('second', o_orderdate) AS seconds, date_trunc('second', o_orderdate) AS millis, date_trunc('second', o_orderdate) - INTERVAL 8 HOUR AS offset_text, CAST(o_orderdate AS DATE) AS day FROM orders",
)
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    body = F.to_json(F.struct("o_orderkey", F.unix_seconds(d).alias("seconds"), (F.unix_seconds(d) * 1000).alias("millis"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'+08:00'").alias("offset_text"), F.date_format(d, "yyyy-MM-dd").alias("day")))
    out = co.align(paths.parse_body(o.select(body.alias("value"))), [("o_orderkey", "bigint"), ("seconds", "timestamp"), ("millis", "timestamp(3)"), ("offset_text", "timestamp with time zone"), ("day", "date")])
    return out.select("o_orderkey", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("seconds", "millis", "offset_text")], "day")


def _payloads(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("doc_id", "lang"))).otherwise(F.concat(F.lit("bad "), "text")).alias("value"), "lang")
    return paths.parse_body(d)


@_query("dead_letter_split", "SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'not a JSON object' WHEN lang IN ('de', 'fr') THEN 'language' END AS reason FROM documents")
def _(spark, sf_dir):
    good, bad = sinks.split_bad(_payloads(spark, sf_dir), [(F.col("body").isNotNull(), "not a JSON object"), (~F.col("lang").isin("de", "fr"), "language")])
    return good.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("doc_id", "reason"))


@_query(
    "error_envelope",
    f"SELECT doc_id, 'failed' AS message, '{NOW}' AS at, 'trino' AS sink, lang AS meta_lang, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS original_id, CASE WHEN doc_id % 2 <> 0 THEN md5('bad ' || text) END AS original_data FROM documents",
)
def _(spark, sf_dir):
    df = _payloads(spark, sf_dir)
    envelope = sinks.error_envelope(F.col("value"), F.lit("failed"), F.lit(NOW), "trino", F.create_map(F.lit("lang"), F.col("lang")))
    out = paths.parse_body(df.select("doc_id", envelope.alias("value")))
    data = _at("original_message.original_data", "string")
    return out.select("doc_id", _at("error.message", "string").alias("message"), _at("error.timestamp", "string").alias("at"), _at("error.original_sink", "string").alias("sink"), _at("error.metadata.lang", "string").alias("meta_lang"), _at("original_message.doc_id", "bigint").alias("original_id"), F.md5(data.cast("binary")).alias("original_data"))


@_query("row_to_json", "SELECT c_custkey, 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS id, true AS has_null FROM customer")
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("nothing", F.lit(None).cast("string"))
    out = paths.parse_body(readers.to_messages(c, "customer", "c_custkey"))
    return out.select(_at("c_custkey", "bigint").alias("c_custkey"), F.col("meta")["table"].alias("table"), F.col("meta")["id"].alias("id"), paths.variant_exists(F.col("body"), "nothing").alias("has_null"))


@_query("unwrap_avro_arrays", "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey")
def _(spark, sf_dir):
    line = F.struct(F.struct(F.array("l_quantity").alias("array")).alias("parts"))
    nested = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.struct(F.collect_list(line).alias("array")).alias("lines"))
    out = readers.unwrap_all(nested)
    return out.select("l_orderkey", F.size("lines").cast("bigint").alias("n"), F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["parts"][0]).alias("quantity"))


@_query("unwrap_avro_arrays_dynamic", "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey")
def _(spark, sf_dir):
    line = F.struct(F.struct(F.array("l_quantity").alias("array")).alias("parts"))
    nested = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.struct(F.collect_list(line).alias("array")).alias("lines"))
    out = readers.unwrap_bodies(paths.parse_body(nested.select(F.to_json(F.struct("l_orderkey", F.struct("lines").alias("order"))).alias("value"))))
    lines = paths.variant_at(F.col("body"), "order.lines").try_cast("array<struct<parts: array<double>>>")
    return out.select(_at("l_orderkey", "bigint").alias("l_orderkey"), F.size(lines).cast("bigint").alias("n"), F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["parts"][0]).alias("quantity"))


@_query("confluent_frame_split", "SELECT event_id, event_id % 2 = 0 AS framed, CASE WHEN event_id % 2 = 0 THEN (user_id % 1000)::INT END AS schema_id, event_type AS payload FROM events")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    header = F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(F.col("user_id") % 1000), 8, "0")))
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(header, F.col("event_type").cast("binary"))).otherwise(F.col("event_type").cast("binary"))
    out = e.select("event_id", readers.split_frame(raw).alias("f"))
    return out.select("event_id", "f.framed", "f.schema_id", F.col("f.payload").cast("string").alias("payload"))


_LINES = "SELECT l_orderkey, list({q: l_quantity, f: l_returnflag, l: l_linenumber} ORDER BY l_linenumber, l_quantity, l_returnflag) AS x FROM lineitem GROUP BY l_orderkey"


@_query(
    "path_queries",
    f"""WITH o AS ({_LINES}) SELECT l_orderkey, list_filter(x, lambda e: e.f = 'R')[1].q AS first_returned, len(list_filter(x, lambda e: e.q > 25)) AS large, coalesce(list_sum(list_transform(list_filter(x, lambda e: e.q <= 10), lambda e: e.q)), 0) AS small_sum,
    len(list_filter(x, lambda e: e.f <> 'N')) > 0 AS any_other FROM o""",
)
def _(spark, sf_dir):
    """Lines of orders picked by conditions in paths, in both lanes, which agree."""
    line = F.struct("l_linenumber", "l_quantity", "l_returnflag")
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    asked = {"first_returned": 'lines.#(l_returnflag=="R").l_quantity', "large": "lines.#(l_quantity>25)#.#", "small": "lines.#(l_quantity<=10)#.l_quantity", "any_other": 'lines.#(l_returnflag!="N")'}
    typed = t.chain([t.filter_rows("lines.#(l_linenumber>0)")])(orders)
    body = F.col("body")
    dynamic = paths.parse_body(typed.select("l_orderkey", "lines", F.to_json(F.struct("lines")).alias("value")))
    at = {n: paths.variant_at(body, p) for n, p in asked.items()}
    own = {n: paths.typed_at(p, typed.schema) for n, p in asked.items()}
    both = dynamic.select(
        "l_orderkey", at["first_returned"].cast("double").alias("first_returned"), F.when(at["large"].cast("bigint") == own["large"], at["large"].cast("bigint")).alias("large"),
        F.when(at["small"].cast("array<double>") == own["small"], F.aggregate(own["small"], F.lit(0.0), lambda s, x: s + x)).alias("small_sum"), predicates.condition(dynamic, asked["any_other"]).alias("any_other"), own["first_returned"].alias("__own"),
    )
    return both.select("l_orderkey", F.when(F.col("first_returned").eqNullSafe(F.col("__own")), F.col("first_returned")).otherwise(-1.0).alias("first_returned"), "large", "small_sum", "any_other")


@_query("kafka_record", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS key, 'out' AS topic FROM events")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id")).alias("value"), F.create_map(F.lit("key"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string"))).alias("meta"))
    return sinks.kafka_record(e, "out").select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), "key", "topic")


@_query("documents_sink", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf_dir):
    out = sinks.as_documents(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    return out.select(F.from_json("data", "o_orderkey bigint, o_totalprice double").alias("d")).select("d.*")


@_query("run_totals", "SELECT count(*) AS processed, count(*) FILTER (event_type = 'error') AS errors FROM events")
def _(spark, sf_dir):
    return reports.run_totals(_table(spark, sf_dir, "events"), F.col("event_type") == "error")


@_query("labelled_counts", "SELECT event_type, user_id % 10 AS shard, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return reports.counts(_table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("shard")), ["event_type", "shard"])


def _rate_sql(seconds: int) -> str:
    return f"SELECT to_timestamp(floor(epoch(ts) / {seconds}) * {seconds})::TIMESTAMP AS window_start, event_type, count(*) / {seconds}.0::DOUBLE AS per_second FROM events GROUP BY 1, 2"


@_query("throughput_10s", _rate_sql(10))
def _(spark, sf_dir):
    return reports.throughput(_table(spark, sf_dir, "events"), ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("rate_5m", _rate_sql(300))
def _(spark, sf_dir):
    return reports.rate(_table(spark, sf_dir, "events"), ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("success_rate", "SELECT user_id % 10 AS shard, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END)::DOUBLE AS success_rate FROM events GROUP BY 1")
def _(spark, sf_dir):
    return reports.success_rate(_table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 10), F.col("event_type") == "error", ["shard"])


def _histogram_sql(table: str, value: str, kind: str, label: str) -> str:
    limits = ", ".join(f"({b!r}::DOUBLE)" for b in reports.bounds(kind))
    return f"SELECT {label}, le, count(*) FILTER (v <= le) AS n FROM (SELECT {label}, {value} AS v FROM {table}) d, (VALUES {limits}, ('inf'::DOUBLE)) b(le) WHERE v IS NOT NULL GROUP BY {label}, le"


@_query("size_histogram", _histogram_sql("documents", "strlen(text)", "message_size", "lang"))
def _(spark, sf_dir):
    return reports.histogram(_table(spark, sf_dir, "documents"), F.octet_length("text"), "message_size", ["lang"])


@_query("duration_histogram", _histogram_sql("events", "value / 1000", "processing", "event_type"))
def _(spark, sf_dir):
    return reports.histogram(_table(spark, sf_dir, "events"), F.col("value") / 1000, "processing", ["event_type"])


@_query(
    "histogram_quantile",
    f"""WITH h AS ({_histogram_sql("events", "value / 1000", "processing", "event_type")}),
    r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before, 0.95::DOUBLE * max(n) OVER (PARTITION BY event_type) AS rnk FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
    f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS i FROM r WHERE n >= rnk AND n > 0)
    SELECT event_type, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rnk - before) / (n - before) END AS quantile FROM f WHERE i = 1""",
)
def _(spark, sf_dir):
    return reports.histogram_quantile(reports.histogram(_table(spark, sf_dir, "events"), F.col("value") / 1000, "processing", ["event_type"]), 0.95, ["event_type"])


@_query("mean_duration", "SELECT event_type, avg(value) AS mean_duration FROM events GROUP BY 1")
def _(spark, sf_dir):
    return reports.mean_duration(_table(spark, sf_dir, "events"), "value", ["event_type"])


@_query("latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def _(spark, sf_dir):
    return reports.latest(_table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], ["user_id"])


_COUNTER_RATE = (
    "SELECT user_id, ts, rate FROM (SELECT user_id, ts, (CASE WHEN event_id % 7 >= b THEN event_id % 7 - b ELSE event_id % 7 END) / ((epoch_us(ts) - epoch_us(a)) / 1e6) AS rate, a, epoch_us(ts) > epoch_us(a) AS ok FROM (SELECT *, lag(event_id % 7) OVER w AS b, lag(ts) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) WHERE ok"
)


@_query("counter_rate", _COUNTER_RATE)
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "ts", F.struct("ts", "event_id").alias("at"), (F.col("event_id") % 7).alias("value"))
    return reports.counter_rate(e.select("user_id", "ts", "value", F.col("at.event_id").alias("event_id")), ["user_id"], "ts").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "rate")


@_query("counter_rate_stream", _COUNTER_RATE)
def _(spark, sf_dir):
    """Counters of events as a stream of two batches, with a restart between them; what waits for the watermark at the end is read from the state."""
    table, folder = polling.ParquetTable(f"{sf_dir}/events.parquet", "event_id"), shared_folder(spark)
    for limit in (2_000, None):
        events = polling.poll(spark, table, "event_id long, ts timestamp_ntz, user_id long", max_rows=limit)
        samples = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7).alias("value"))
        made = rates.counter_rate(samples, ["user_id"], delay="1 hour")
        made.writeStream.format("parquet").options(path=f"{folder}/rows", checkpointLocation=f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{folder}/rows").unionByName(rates.waiting(spark, f"{folder}/checkpoint", ["user_id"]))
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "rate")


@_query("message_id", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) ELSE '' END AS message_id FROM events")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    meta = F.create_map(F.lit("id"), F.when(k == 0, F.col("event_type")), F.lit("partition"), F.when(k == 1, F.col("user_id").cast("string")), F.lit("offset"), F.when(k == 1, F.col("event_id").cast("string")))
    return e.select("event_id", reports.message_id(meta).alias("message_id"))
