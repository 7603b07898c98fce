import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import deep, paths
from millrace.operators import transforms as t
from millrace.sources import readers


def bodies(spark, *documents):
    return paths.parse_body(spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "value string"))


def values(df):
    return [json.loads(r.v) if r.v else None for r in df.select(F.to_json("body").alias("v")).collect()]


def python_in(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Python" in plan or "Pandas" in plan


SAME = [
    {"userId": 1, "homeAddr": {"zipCode": "x", "geoPos": [{"latDeg": 1.50, "lonDeg": None}, {}]}, "allTags": [[{"kV": True}], []]},
    {"homeAddr": {"geoPos": []}, "HTTPPort": 12345678901234567890},
    {"userId": None, "homeAddr": None},
    {},
]


def test_shapes():
    levels = lambda text: deep.shape_of(text).levels
    assert levels("BIGINT") == [] and levels("OBJECT<a: BIGINT, b: ARRAY<OBJECT<c: STRING>>>") == [{"OBJECT"}, {"ARRAY"}, {"OBJECT"}]
    assert levels("OBJECT<a: ARRAY<BIGINT>, b: OBJECT<c: ARRAY<VOID>>>") == [{"OBJECT"}, {"ARRAY", "OBJECT"}, {"ARRAY"}]
    assert deep.shape_of("OBJECT<a: VARIANT>") is None
    odd = deep.shape_of("OBJECT<VARIANT: BIGINT, `x>ARRAY<: ``y`: STRING, é: DECIMAL(3,1)>")
    assert odd.levels == [{"OBJECT"}] and odd.keys == {"VARIANT", "x>ARRAY<: `y", "é"}


def test_shapes_of_real_keys(spark):
    document = {"a b": {"x.y": 1}, "`q`": [{"é": 1}], "VARIANT": {"ARRAY<": "s"}, "": 1, "a:b": 2}
    shape = deep.body_shape(bodies(spark, document))
    assert shape.keys == {"a b", "x.y", "`q`", "é", "VARIANT", "ARRAY<", "", "a:b"} and shape.levels == [{"OBJECT", "ARRAY"}, {"OBJECT"}]


def test_deep_names_without_python(spark):
    df = bodies(spark, *SAME, "no json", "[1]")
    out = t.snake_case(True)(df)
    assert not python_in(out)
    snake = [
        {"user_id": 1, "home_addr": {"zip_code": "x", "geo_pos": [{"lat_deg": 1.5, "lon_deg": None}, {}]}, "all_tags": [[{"k_v": True}], []]},
        {"home_addr": {"geo_pos": []}, "http_port": 12345678901234567890},
        {"user_id": None, "home_addr": None},
        {},
        None,
        None,
    ]
    assert values(out) == snake
    assert values(t.camel_case(True)(out))[0] == {"UserId": 1, "HomeAddr": {"ZipCode": "x", "GeoPos": [{"LatDeg": 1.5, "LonDeg": None}, {}]}, "AllTags": [[{"KV": True}], []]}


def test_kinds_that_conflict_go_by_text_with_the_same_result(spark):
    mixed = [*SAME, {"homeAddr": 5}, {"homeAddr": [{"innerKey": {"deepKey": 1}}]}]
    out = t.snake_case(True)(bodies(spark, *mixed))
    assert python_in(out) and values(out)[:4] == values(t.snake_case(True)(bodies(spark, *SAME))) and values(out)[5] == {"home_addr": [{"inner_key": {"deep_key": 1}}]}


def test_last_of_equal_names_stays(spark):
    assert values(t.snake_case(True)(bodies(spark, '{"a":{"bC":1,"b_c":2},"aB":1,"a_b":[{"x":0}]}'))) == [{"a": {"b_c": 2}, "a_b": [{"x": 0}]}]


@pytest.mark.parametrize("more", [[], [{"a": 5}, {"a": {"x": 1}}]])
def test_arrays_are_unwrapped_at_any_depth(spark, more):
    documents = [
        {"a": {"array": [{"b": {"array": [{"array": []}, {"array": [1]}, {"z": 1}]}}, {"q": "text"}]}, "c": {"array": 1}, "d": {"array": [1], "e": 2}},
        {"a": {"array": None}, "array": [{"array": [3]}]},
    ]
    out = readers.unwrap_bodies(bodies(spark, *documents, *more))
    assert python_in(out) == bool(more)
    assert values(out)[:2] == [{"a": [{"b": [[], [1], {"z": 1}]}, {"q": "text"}], "c": {"array": 1}, "d": {"array": [1], "e": 2}}, {"a": {"array": None}, "array": [[3]]}]


def test_empty(spark):
    df = bodies(spark, {"aB": 1}).limit(0)
    assert t.snake_case(True)(df).count() == 0 and readers.unwrap_bodies(df).count() == 0


def test_many_keys_go_by_the_expression(spark):
    document = {"outer": {f"someKey{i}Name": i for i in range(120)}}
    assert values(t.snake_case(True)(bodies(spark, document))) == [{"outer": {f"some_key{i}_name": i for i in range(120)}}]
