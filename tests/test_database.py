import json
import math

import pytest
from pyspark.sql import functions as F

from derby import Derby, refused
from millrace.functions import paths
from millrace.operators import database, sinks


@pytest.fixture
def db(tmp_path):
    return database.Database(f"jdbc:derby:{tmp_path}/db;create=true")


def do(spark, db, *statements):
    with db.transaction(spark) as connection:
        for sql in statements:
            database.run(connection, sql)


def read(spark, db, table):
    return sorted(map(tuple, spark.read.format("jdbc").options(url=db.url, dbtable=table, **db.options).load().collect()), key=str)


def tables(spark, db):
    with db.transaction(spark) as connection:
        rows, out = connection.getMetaData().getTables(None, None, None, None), []
        while rows.next():
            out += [rows.getString("TABLE_NAME")] if rows.getString("TABLE_TYPE") == "TABLE" else []
        return sorted(out)


def test_a_batch_takes_effect_once(spark, db, monkeypatch):
    do(spark, db, "CREATE TABLE items (id BIGINT PRIMARY KEY, name VARCHAR(20), n INT)", "INSERT INTO items VALUES (1, 'a', 1), (2, 'b', 2)")
    batch = spark.createDataFrame([(2, "x", 8, 1), (2, "y", 9, 2), (3, "c", 3, 1)], "id long, name string, n int, at int")
    merge = lambda number, df=batch: database.merge(df.drop("at"), db, "items", ["id"], [F.col("n")], batch=("flow", number))
    real = database.mark

    def broken(*_):
        raise RuntimeError("lost between merge and mark")

    monkeypatch.setattr(database, "mark", broken)
    with pytest.raises(RuntimeError, match="lost"):
        merge(7)
    assert read(spark, db, "items") == [(1, "a", 1), (2, "b", 2)], "the merge is taken back with its mark"
    monkeypatch.setattr(database, "mark", real)
    assert merge(7) is True
    want = [(1, "a", 1), (2, "y", 9), (3, "c", 3)]
    assert read(spark, db, "items") == want
    do(spark, db, "UPDATE items SET n = 100 WHERE id = 3")
    assert merge(7) is False and read(spark, db, "items")[2] == (3, "c", 100), "a batch that comes again changes nothing"
    assert merge(8) is True and read(spark, db, "items") == want
    assert tables(spark, db) == ["ITEMS", "MILLRACE_BATCHES"], "no staging table stays"


def test_absent_columns_keep_their_values_and_nulls_are_set(spark, db):
    do(spark, db, "CREATE TABLE items (a INT, b VARCHAR(5), x INT, y VARCHAR(20), PRIMARY KEY (a, b))", "INSERT INTO items VALUES (1, 'k', 1, 'old'), (2, 'k', 2, 'old'), (2, 'm', 3, 'old')")
    lines = [{"a": 1, "b": "k", "x": 10}, {"a": 1, "b": "k", "y": None}, {"a": 2, "b": "k", "y": "new"}, {"a": 2, "b": "k", "x": 20}, {"a": 3, "b": "k", "x": 5}, {"a": 2, "b": "k", "x": 21, "extra": 0}]
    df = paths.parse_body(spark.createDataFrame([(i, json.dumps(line)) for i, line in enumerate(lines)], "i int, value string").repartition(3))
    brought = df.select("i", F.map_keys("body").alias("names"), *[paths.variant_at(F.col("body"), c).try_cast(kind).alias(c) for c, kind in (("a", "int"), ("b", "string"), ("x", "int"), ("y", "string"))])
    rows = brought.select("a", "b", "x", "y", "names", "i")
    with pytest.raises(ValueError, match="'i'"):
        database.merge(rows, db, "items", ["a", "b"], [F.col("i")], present="names")
    folded = database.fold(rows, ["a", "b"], "i", True, "names").orderBy("a", "b").collect()
    assert [tuple(r) for r in folded] == [(1, "k", 10, "", "12"), (2, "k", 21, "new", "11"), (3, "k", 5, "", "10")]
    one = rows.where("i in (0, 2, 4)").drop("i")
    database.merge(one, db, "items", ["a", "b"], [F.lit(1)], present="names")
    assert read(spark, db, "items") == [(1, "k", 10, "old"), (2, "k", 2, "new"), (2, "m", 3, "old"), (3, "k", 5, None)]
    database.merge(rows.where("i in (1, 3)").drop("i"), db, "items", ["a", "b"], [F.lit(1)], present="names")
    assert read(spark, db, "items") == [(1, "k", 10, None), (2, "k", 20, "new"), (2, "m", 3, "old"), (3, "k", 5, None)]


def test_login_and_insert_ignore(spark, db):
    do(spark, db, "CREATE SCHEMA me", "CREATE TABLE me.own (id INT PRIMARY KEY, v INT)")
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "id int, v int")
    with pytest.raises(ValueError, match="own"):  # nobody's schema has it
        sinks.merge_jdbc(df, db.url, "own", ["id"], [F.col("v")])
    for rows in (df, df.where("v = 6")):
        assert sinks.merge_jdbc(rows, db.url, "own", ["id"], [F.col("v")], update=False, user="me", password="secret")
    assert read(spark, database.Database(db.url, {"user": "me", "password": "secret"}), "own") == [(1, 5), (2, 7)]


def test_rows_that_the_database_refuses_are_told_apart(spark, db, tmp_path):
    do(spark, db, "CREATE TABLE items (id BIGINT PRIMARY KEY, v INT NOT NULL CHECK (v < 1000), name VARCHAR(10))", "CREATE TABLE chunks (chunk VARCHAR(200) PRIMARY KEY)", "INSERT INTO items VALUES (70, 1, 'there')")
    bad = {13: (13, 1000, "x"), 14: (14, 5000, "x"), 70: (70, 1, "again"), 150: (150, 2, "far too long a name"), 399: (399, None, "x")}
    data = [bad.get(i, (i, i % 1000, f"n{i}")) for i in range(400)]
    connect = Derby(spark, db.url)
    connect.log = str(tmp_path / "log")
    df = spark.createDataFrame(data, "id long, v int, name string").coalesce(1).persist()
    for path in (str(tmp_path / "one"), str(tmp_path / "two")):  # the second time as a task that runs again
        out = database.write_isolated(df.select(F.col("id").alias("ID"), F.col("v").alias("V"), F.col("name").alias("NAME")), connect, "items", path, rows_a_write=100, refused=refused, ledger="chunks")
        assert sorted(r.ID for r in out.collect()) == sorted(bad) and all(r.reason for r in out.collect())
    assert [r[0] for r in read(spark, db, "items")] == sorted([i for i in range(400) if i not in bad] + [70], key=str)
    with open(connect.log) as log:
        first = len(log.readlines()) / 2
    assert first <= 4 + len(bad) * 2 * math.ceil(math.log2(100))
    broken = lambda: (_ for _ in ()).throw(RuntimeError("no connection"))
    with pytest.raises(Exception, match="no connection"):
        database.write_isolated(df, broken, "items", str(tmp_path / "three"), refused=refused)
    df.unpersist()


def test_targets_are_looked_up_or_made(spark, db):
    do(spark, db, "CREATE TABLE typed (id INT NOT NULL, amount DECIMAL(8,2), made_at TIMESTAMP, note VARCHAR(50) DEFAULT 'none', seq BIGINT GENERATED ALWAYS AS IDENTITY, must VARCHAR(9) NOT NULL)")
    typed = database.target(spark, db, "typed")
    assert [c for c, _ in typed.columns] == ["ID", "AMOUNT", "MADE_AT", "NOTE", "SEQ", "MUST"] and typed.required == ["ID", "MUST"] and not typed.documents
    with pytest.raises(ValueError, match="no table"):
        database.target(spark, db, "documents")
    made = database.target(spark, db, "documents", create=True)
    assert made.documents and [c for c, _ in made.columns] == ["ID", "DATA", "CREATED_AT"] and made.required == []
    assert database.target(spark, db, "documents", create=True) == made
    messages = paths.parse_body(spark.createDataFrame([('{"a":{"b":[1,2]}}',), ('{"c":"é"}',)], "value string"))
    database.write_rows(messages.select("body"), db, made)
    got = spark.read.format("jdbc").options(url=db.url, dbtable="documents").load().collect()
    assert sorted(json.loads(r.DATA).popitem() for r in got) == [("a", {"b": [1, 2]}), ("c", "é")] and sorted(r.ID for r in got) == [1, 2] and all(r.CREATED_AT for r in got)
    rows = spark.createDataFrame([("7", "12.345", "2024-01-02T03:04:05Z", "m", 1)], "id string, amount string, made_at string, must string, extra int")
    columns = database.Target("typed", [c for c in typed.columns if c[0] != "SEQ"], typed.required, False)
    database.write_rows(rows.select(F.col("id").cast("int").alias("id"), F.col("amount").cast("double").alias("amount"), "made_at", "must", "extra"), db, columns)
    (row,) = spark.read.format("jdbc").options(url=db.url, dbtable="typed").load().collect()
    assert (row.ID, float(row.AMOUNT), row.MADE_AT.isoformat(), row.NOTE, row.MUST) == (7, 12.35, "2024-01-02T03:04:05", "none", "m")


def test_statements():
    with_mask = database.merge_statement("t", "s", ["id", "v"], ["id"], True, "postgresql", "p")
    assert with_mask == (
        "INSERT INTO t (id, v) SELECT s.id, CASE WHEN SUBSTR(s.p, 1, 1) = '1' THEN s.v END FROM s s ON CONFLICT (id) "
        "DO UPDATE SET v = CASE WHEN (SELECT SUBSTR(p.p, 1, 1) FROM s p WHERE p.id = EXCLUDED.id) = '0' THEN t.v ELSE EXCLUDED.v END"
    )
    assert database.merge_statement("t", "s", ["id"], ["id"], True, "postgresql").endswith("DO NOTHING")
    assert database.DOCUMENT_TABLES["trino"] == ["CREATE TABLE IF NOT EXISTS {table} (data VARCHAR)"]
