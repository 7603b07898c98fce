import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import paths, predicates
from millrace.operators import transforms as t

DOCUMENT = {
    "friends": [
        {"first": "Dale", "last": "Murphy", "age": 44, "nets": ["ig", "fb", "tw"], "ok": True},
        {"first": "Roger", "last": "Craig", "age": 68, "nets": ["fb", "tw"], "ok": False},
        {"first": "Jane", "last": "Murphy", "age": 47, "nets": ["ig", "tw"], "addr": {"zip": "a.b"}},
    ],
    "tags": ["x", "yy", "x)y"],
    "n": 5,
}
CASES = [
    ('friends.#(last=="Murphy").first', "Dale"), ('friends.#(last=="Murphy")#.first', ["Dale", "Jane"]), ("friends.#(age>45)#.last", ["Craig", "Murphy"]), ("friends.#(age<=44).first", "Dale"), ('friends.#(first%"D*").last', "Murphy"),
    ('friends.#(first!%"?a*")#.first', ["Roger"]), ('friends.#(nets.#(=="fb"))#.first', ["Dale", "Roger"]), ("friends.#(ok==true).first", "Dale"), ("friends.#(ok==false).first", "Roger"), ('friends.#(last!="Murphy").age', 68),
    ('friends.#(last=="Nobody").first', None), ('friends.#(last=="Nobody")#.first', []), ('tags.#(=="yy")', "yy"), ('tags.#(%"x*")#', ["x", "x)y"]), ('tags.#(=="x)y")', "x)y"), ('friends.#(addr.zip=="a.b").first', "Jane"), ("friends.#(age>45)#.#", 2),
    ("friends.#.first", ["Dale", "Roger", "Jane"]), ("friends.#", 3), ("friends.1.first", "Roger"), ('$.friends.#( last == "Craig" ).nets.0', "fb"), ("friends.#(addr).first", "Jane"), ('friends.#(age=="44").first', None), ('n.#(=="x")', None),
]


@pytest.mark.parametrize("path, want", CASES)
def test_conditions_in_both_lanes(spark, path, want):
    text = json.dumps(DOCUMENT)
    dynamic = paths.parse_body(spark.createDataFrame([(text,)], "value string"))
    got = dynamic.select(F.to_json(paths.variant_at(F.col("body"), path)).alias("v")).first().v
    assert (None if got is None else json.loads(got)) == want
    schema = "friends array<struct<first: string, last: string, age: bigint, nets: array<string>, ok: boolean, addr: struct<zip: string>>>, tags array<string>, n bigint"
    typed = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", schema).alias("d")).select("d.*")
    kind = paths.typed_type(typed.schema, path)
    row = None if kind is None else typed.select(paths.typed_at(path, typed.schema).alias("v")).first().v
    assert row == want
    assert kind is None or typed.select(paths.typed_at(path, typed.schema).alias("v")).schema["v"].dataType.simpleString() == kind.simpleString()


def test_filter_and_select_by_conditions(spark):
    df = paths.parse_body(spark.createDataFrame([(json.dumps(DOCUMENT),), ('{"friends":[{"last":"X","age":1}]}',)], "value string"))
    assert t.filter_rows('friends.#(last=="Murphy").first == \'Dale\'')(df).count() == 1
    assert t.filter_rows('friends.#(last=="X")')(df).count() == 1 and t.filter_rows("friends.#(age>0)#")(df).count() == 2
    chosen = t.select(["friends.#(age>45).age"])(df).select(F.to_json("body").alias("v")).collect()
    assert [json.loads(r.v) for r in chosen] == [{"age": 68}, {"friends": [{"last": "X", "age": 1}]}]


def test_paths_are_split_outside_of_conditions():
    assert paths.segments('a.#(b.c=="x.y)").d') == ["a", '#(b.c=="x.y)")', "d"] and paths.segments("a(b).c") == ["a(b)", "c"]
    assert paths.query_of('#(a.#(b=="c")#.#>1)#') == paths.Query('a.#(b=="c")#.#', ">", 1.0, True) and paths.query_of("#") is None
    with pytest.raises(ValueError, match="unclosed"):
        paths.segments('a.#(b=="c"')
    assert predicates.split_equality('a.#(b=="c").d == \'e\'') == ('a.#(b=="c").d', "e") and predicates.split_equality('a.#(b=="c")') is None
