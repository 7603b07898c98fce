import math
import random
import re

from pyspark.sql import functions as F

from millrace.llm import langid

SYLLABLES = {"aa": "the thi and ing ous ble ter men", "bb": "cio mente ado ña que llo rra oso", "cc": "eau ère ment aux oui tre çai nou"}


def text_of(rng, lang, n):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows_of(n=600, seed=2):
    rng = random.Random(seed)
    return [(i, text_of(rng, lang := rng.choice(["aa", "aa", "aa", "bb", "cc"]), rng.randint(3, 60)), lang) for i in range(n)]


def plain(rows, texts, langs, least=3):
    """Sums over words of log frequencies by the plainest means."""
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = [{} for _ in range(langid.LONGEST + 1)]
    for _, text, lang in rows:
        for w in words(text):
            for n in range(langid.LONGEST + 1):
                for g in [w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]:
                    by = counts[n].setdefault(g, dict.fromkeys(langs, 0))
                    by[lang] += 1
    totals = [{k: max(1, sum(by[k] for by in c.values())) for k in langs} for c in counts]
    kept = [{g: by for g, by in c.items() if sum(by.values()) >= least} for c in counts]
    gain = lambda n, g, k: math.log(kept[n][g][k] + 0.5) - math.log(totals[n][k] + 0.5 * max(1, len(kept[n])))
    out = []
    for text in texts:
        sums = dict.fromkeys(langs, 0.0)
        for w in words(text):
            if w in kept[0]:
                for k in langs:
                    sums[k] += gain(0, w, k)
                continue
            for n in range(langid.LONGEST, 0, -1):
                known = [g for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in kept[n]]
                if known:
                    for k in langs:
                        sums[k] += sum(gain(n, g, k) for g in known) / len(known)
                    break
        out.append(sums)
    return out


def test_sums_against_a_plain_version(spark):
    rows = rows_of(150)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.learn(df)
    keep = {r.doc_id for r in df.where(langid.remainder(F.col("doc_id")) != 0).collect()}
    assert model.langs == ["aa", "bb", "cc"] and 0 < len(keep) < 150
    texts = [*(t for _, t, _ in rows[:40]), "zzz qqq x", "Thering, MENTEQ! ñaux-eau", "x" * 30]
    sums, words = model.sums(texts)
    want = plain([r for r in rows if r[0] in keep], texts, model.langs)
    assert all(abs(sums[i, k] - want[i][lang]) < 1e-6 for i in range(len(texts)) for k, lang in enumerate(model.langs))
    assert words.tolist() == [len(re.findall(r"[^\W\d_]+", t)) for t in texts]


def test_held_out_accuracy_and_odd_texts(spark):
    rows = rows_of()
    long = " ".join(t for _, t, k in rows * 40 if k == "bb")  # spans several batches
    odd = [(9000, None, "aa"), (9001, "", "bb"), (9002, "12 34 !? _", "cc"), (9003, "́̂", None), (9004, long, None), (9005, "eaumentère" * 60_000, None), (None, "the thi and", "aa"), (9006, "ΣΊΣΥΦΟΣ", None), (1, rows[0][1], "aa"), (1, rows[0][1], "aa")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double").repartition(6)
    model = langid.learn(df)
    got = langid.predict(df.select("doc_id", "text", "lang_pred", "score"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows) + len(odd)
    by = {r.doc_id: r for r in found}
    held = [r.doc_id for r in df.where(langid.remainder(F.col("doc_id")) == 0).collect()]
    assert sum(by[i].lang_pred == rows[i][2] for i in held if i < 600) >= 0.97 * sum(i < 600 for i in held)
    assert [by[i].lang_pred for i in (9000, 9001, 9002, 9003)] == ["und"] * 4 and all(by[i].score == 0 for i in (9000, 9001, 9002, 9003))
    assert by[9004].lang_pred == "bb" and by[9005].lang_pred == "cc" and by[9006].lang_pred in model.langs
    assert all(0 <= r.score <= 1 for r in found)


def test_pieces_hold_whole_texts_once():
    texts = ["a b", None, "", "word " * 400_000, "x" * 1_500_000, "end"]
    joined = {i: "" for i in range(len(texts))}
    for held, owner in langid.pieces(texts):
        assert sum(map(len, held)) <= langid._PIECE
        for part, i in zip(held, owner, strict=True):
            joined[i] += part
    assert [joined[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (None, "more", "aa")], "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert model.langs == [] and [(r.lang_pred, r.score) for r in langid.predict(df, model).collect()] == [("und", 0.0)] * 2
    assert langid.predict(df.limit(0), model).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = rows_of(80, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = df.withColumn("lang", F.when(langid.remainder(F.col("doc_id")) == 0, "aa").otherwise(F.col("lang")))
    sums = [langid.learn(x.repartition(3)).sums([t for _, t, _ in rows])[0] for x in (df, other)]
    assert (abs(sums[0] - sums[1]) < 1e-9).all()
