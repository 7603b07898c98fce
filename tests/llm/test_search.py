import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """By definition, for every row of items."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 10 + 90 * b.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def tables(seed=1, n=500):
    rng = random.Random(seed)
    words = [f"{rng.choice(['é', 'w', 'Q'])}{i}" for i in range(400)]
    text = lambda most: " ".join(words[min(399, int(rng.paretovariate(0.4)))] for _ in range(rng.randint(1, most)))
    docs = [(i, text(80)) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[7][1]), (2000, None), (2001, ""), (2002, " .,;"), (2003, "w1 " * 200_000), (2004, docs[3][1].upper())]
    items = [(i, text(30)) for i in range(60)] + [(3, docs[7][1]), (3, docs[7][1]), (None, docs[9][1]), (70, None), (71, ""), (72, "absent words only"), (73, "W1 w1, w1")]
    return docs, items


@pytest.mark.parametrize("most_items", [2048, 9])
def test_against_the_definition(spark, most_items):
    docs, items = tables()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, rank int").repartition(7)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = search.search(d, i, most_items=most_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_bounds_hold_and_save_work():
    docs, items = tables(5, 2000)
    rng = np.random.default_rng(0)
    places, weights = rng.integers(0, 16, 400), rng.integers(1, 9000, 400)
    impact = rng.integers(1, 1000, (50, 400)) * (rng.random((50, 400)) < 0.1) * weights
    doc, term = np.nonzero(impact)
    sketch = search.sketches(doc, places[term], impact[doc, term], 50, 16)
    for _ in range(30):
        asked = rng.choice(400, 12, replace=False)
        bound = sketch[:, places[asked]].sum(1)
        assert (bound >= impact[:, asked].sum(1)).all()


def test_narrow_sketches_change_nothing(spark, monkeypatch):
    # bounds of eight places are loose, and batches of few documents give many thresholds
    docs, items = tables(2, 150)
    monkeypatch.setattr(search, "_BATCH", 8)
    monkeypatch.setattr(search, "_STEP", 2)
    monkeypatch.setattr(search, "PLACES", 8)
    d, i = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in search.search(d, i, k=3).collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(none, items).count() == 0 and search.search(some, items.limit(0)).count() == 0 and search.search(some, items).count() == 1
