import random
import re
from collections import Counter

import pytest

from millrace.llm import divergence


def rows_of(seed=3, n=400, sources=7):
    rng, words = random.Random(seed), [f"w{i}" for i in range(0)]
    words = ["".join(rng.choice("abcdéñ") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr"])
        source = "s0" if rng.random() < 0.4 else f"s{rng.randrange(sources)}"
        k = [int(rng.paretovariate(0.6)) % len(words) for _ in range(rng.randint(0, 50))]
        out.append((i, rng.choice([" ", ", ", "1"]).join(words[j] if rng.random() < 0.8 else words[j].upper() for j in k), lang, source))
    return out


def brute(rows, least, top):
    """By definition, in whole numbers of any size."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for k, _, terms in docs if k == lang for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter(t for k, o, terms in docs if (k, o) == (lang, s) for t in terms if t in set(kept)) for s in {o for k, o, _ in docs if k == lang}}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (c.total() + 5 * len(kept))  # noqa: B023, E731
        for s, c in counts.items():
            found = [(-sum(abs(p(c, t) - p(o, t)) for t in kept), other.encode()) for other, o in counts.items() if other != s]
            out |= {(lang, s, "pair", item.decode(), -v, r) for r, (v, item) in enumerate(sorted(found), 1)}
            found = sorted((p(whole, t) - p(c, t), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t))[:top]
            out |= {(lang, s, "term", item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)}
    return out


ODD = [(900, None, None, None), (901, "", "fr", None), (902, "nothing kept here", "xx", "s1"), (903, None, "xx", "s2"), (904, "a b " * 40_000, "en", "s3"), (904, "a b", "en", "s3"), (904, "a b", "en", "s3"), (None, "É é É", "fr", "only")]


@pytest.mark.parametrize("block", [64, 2])
def test_against_the_definition(spark, block):
    rows = rows_of() + ODD
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n int, term string, value string")
    got = divergence.divergence(df.repartition(5), least_docs=6, top=9, block=block).collect()
    want = brute(rows, 6, 9)
    assert len(got) == len(want) and {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got} == want
    assert {r.value for r in got if r.lang == "xx"} == {0}


def test_many_ranges_and_flushes(spark, monkeypatch):
    # chunks, ranges, tiles and flushes smaller than any data
    for name, value in (("_RANGE_BITS", 6), ("_TILE", 50), ("_ENTRIES", 40)):
        monkeypatch.setattr(divergence, name, value)
    rows = rows_of(8, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = divergence.divergence(df, least_docs=2, top=50).collect()
    assert {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got} == brute(rows, 2, 50)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergence(df).collect() == []


def test_shares_of_large_counts_are_exact(spark):
    n, total, v = 123_456_789_012_345_678, 987_654_321_098_765_432, 77_000_000_001
    df = spark.createDataFrame([(n, total, v), (0, 0, 0)], "n long, total long, v long")
    assert [r.p for r in df.select(divergence.share(df.n, df.total, df.v).alias("p")).collect()] == [1 + 1_000_000_000 * (n + 5) // (total + 5 * v), None]
