import random

import corpus_pipeline as cp


def write_tables(spark, path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = text(rng.randint(30, 120))
        if i % 5 == 1:
            t += " scumbag " + text(5)
        rows.append((i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t)))
        labels.append((i, 0, int(i % 5 == 1)))
    passage = text(60)
    rows += [(400 + i, text(80) + " " + passage + " " + text(80), "en", "s1", 1) for i in range(4)]
    rows += [(500, rows[2][1], "en", "s2", 1), (501, rows[2][1] + " tail", "en", "s2", 1), (600, None, None, None, None), (601, "", "en", "s0", 0), (602, "one", "en", "s0", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, passage


def test_stages_take_effect(spark, tmp_path):
    rows, passage = write_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in seen[n]} for n in seen}
    toxic = {i for i in range(300) if i % 5 == 1}
    assert ids["toxicity"] == {r[0] for r in rows} - toxic
    assert ids["near_dedup"] == ids["toxicity"] - {500, 501} and {600, 601, 602} <= ids["near_dedup"]
    by = {r.doc_id: r for r in seen["suffix_dedup"]}
    assert set(by) == ids["near_dedup"] and all(passage not in by[400 + i].text and len(by[400 + i].text) == by[400 + i].n_chars for i in range(4))
    assert by[5].text == rows[5][1] and by[600].text is None
    assert len(seen["mix"]) > 0 and {600, 601} <= ids["mix"] and ids["mix"] <= ids["near_dedup"]
    assert {r.doc_id for r in seen["pack"]} == ids["mix"]
    got = cp.run(spark, str(tmp_path)).collect()
    assert len(got) == len(seen["pack"]) and {r.doc_id for r in got} == ids["mix"]


def test_passages_that_end_inside_characters(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    rows, wanted = [], {}
    # the last bytes of left characters and the first ones of right characters are the same, so a repeat takes in a part of both
    for k, (left, right) in enumerate([("äĤ", "äö"), ("水尴", "€₭"), ("😀🙀", "😀😁")]):
        passage = text(60)
        for j in range(2):
            a, b = text(40) + " " + "\ufffd" * j, " " + text(40) + "\ufffd" * j
            rows.append((10 * k + j, a + left[j] + passage + right[j] + b, "en", "s", 0))
            wanted[10 * k + j] = a + b
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.remove_passages(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == wanted and all(r.n_chars == len(r.text) for r in got)


def test_whole_characters_at_every_cut():
    whole = cp.substrings.whole_characters
    for text in ("aäböc", "a€b水c", "a😀ä€😁", "ä\ufffdö", "水"):
        data = text.encode()
        begins = [len(text[:i].encode()) for i in range(len(text) + 1)]
        for x in range(len(data) + 1):
            for y in range(x + 1, len(data) + 1):
                left = "".join(c for c, s, e in zip(text, begins, begins[1:]) if e <= x or s >= y)
                assert whole(data, [(x, y)]).decode() == left
        assert whole(data, [(0, 1), (len(data) - 1, len(data))]).decode() == text[1:-1]
        assert whole(data, []) == data


def test_stages_on_empty_tables_extra_columns_and_repeated_rows(spark, tmp_path):
    rows, _ = write_tables(spark, tmp_path)
    clash = "doc_id long, text string, lang string, source string, n_chars long, score double, keep boolean, size string, copies int, removed string, predicted int, tags map<string,int>"
    extra = [(*r, 0.5, None, "x", 3, "y", 1, {"a": 1}) for r in [*rows[:40], rows[2], rows[2], (None, "no id " * 30, None, None, None), (None, None, None, None, None)]]
    docs = spark.createDataFrame(extra, clash)
    for name, stage in cp.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        docs = cp.cut(stage(spark, docs, str(tmp_path)))
        assert docs.count() > 0 and none.columns == docs.columns
        if name != "pack":
            assert docs.columns == [c.split()[0] for c in clash.split(", ")] and docs.where("doc_id IS NULL AND text IS NULL").count() == 1
        if name == "near_dedup":
            assert docs.where("doc_id = 2").count() == 1


def test_blank_texts_stay_even_where_no_terms_are_toxic(spark, tmp_path):
    rows = [(i, f"bad bad{i}", "en", "s", 1) for i in range(60)] + [(100, "", "en", "s", 0), (101, None, "en", "s", None), (102, " \n", "en", "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 1) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = cp.reject_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {100, 101, 102}
