import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import substrings, suffix


def corpus(seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    rows = []
    for i in range(120):
        t = rng.choice(base)
        kind = i % 6
        if kind == 1 and t:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("xyz") + t[k + 1 :]
        elif kind == 2:
            t = t[rng.randint(0, 50) :] + rng.choice(base)[:80]
        elif kind == 3:
            t = "ab" * rng.randint(0, 150)
        elif kind == 4:
            t = "".join(rng.choice("abcdé ") for _ in range(100)) + base[0][20:75] + "".join(rng.choice("abcdé ") for _ in range(100))
        rows.append((i, t, "clash", 1))
    return rows + [(500, None, None, None), (501, "", None, None), (502, "short", None, None), (None, base[3], None, None), rows[5], rows[5], (503, "-" * 5000, None, None)]


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"shard_bytes": 2000}])
def test_against_counting_every_string(spark, options):
    rows, length = corpus(), 40
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, removed int")
    out = substrings.remove_repeats(df.repartition(5), length, **options).collect()
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = Counter()
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0])).tolist()
        want[doc_id, kept, tuple(zip(edges[::2], edges[1::2], strict=True))] += 1
    assert Counter((r.doc_id, bytes(r.kept), tuple(map(tuple, r.removed))) for r in out) == want
    assert any(k[2] for k in want) and any(not k[2] for k in want)


def test_texts_longer_than_places(spark):
    """Repeats behind byte 2 ** 24 of a text, in another text and in the same one, are found."""
    long = random.Random(4).randbytes(9 << 20).hex()
    passage, other = long[(17 << 20) : (17 << 20) + 300], "é" + "-~" * 20 + long[50:350]
    df = spark.createDataFrame([(1, long + other), (2, "<" + passage + ">")], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in substrings.remove_repeats(df).select("doc_id", "removed").collect()}
    end = len(long) + len(other.encode())
    assert got == {1: [(50, 350), (17 << 20, (17 << 20) + 300), (end - 300, end)], 2: [(1, 301)]}


def test_stretches_cover_each_string_once():
    rng, length = random.Random(9), 40
    texts = [rng.randbytes(n) for n in (0, 39, 40, 41, 5000, 100, 1064, 1063, 3000)]
    for limit in (64, 1000, 1024, 1 << 20):
        starts = Counter()
        for which, places, held in substrings._batched(texts, length, limit):
            assert sum(map(len, held)) < 2 * limit + length
            for i, at, stretch in zip(which, places, held, strict=True):
                assert texts[i][at : at + len(stretch)] == stretch
            t, _, _, s, n = substrings.segments(held, length)
            for k, at, count in zip(t.tolist(), s.tolist(), n.tolist(), strict=True):
                starts.update((which[k], places[k] + at + x) for x in range(count))
        assert starts == Counter((i, x) for i, t in enumerate(texts) for x in range(len(t) - length + 1))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(df).count() == 0


def test_suffix_arrays_and_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 50))] + [0]
        sa = suffix.suffix_array(np.array(s))
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert sa.tolist() == want
        lcp = suffix.permuted_lcp(np.array(s), sa)
        for a, b in zip(want[:-1], want[1:], strict=True):
            n = 0
            while a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert lcp[b] == n


def test_repeated_strings_do_not_cross_pieces():
    assert [x.tolist() for x in suffix.repeated([b"abcab", b"cabc", b""], 3)] == [[0, 2], [0, 1], []]


def test_what_a_group_shares_is_sorted_as_one_symbol(monkeypatch):
    """The same positions as without, from fewer symbols."""
    rng, length, pieces, cores = np.random.default_rng(4), 60, [], []
    for g in range(6):
        core = rng.integers(0, 256, 40).astype(np.uint8).tobytes()
        for _ in range(8):
            # all strings of 60 bytes hold the core: less than 21 bytes on each side of it
            a, b = (bytes(rng.integers(0, 2, 20).astype(np.uint8))[: int(rng.integers(10, 21))] for _ in (0, 1))
            a = (b"\x01" * 20 + a)[-len(a) :] if g % 2 else a
            pieces.append(a + core + (bytes(20) if g % 3 == 0 else b))
            cores.append(((len(a), len(a) + 40), g))
    sorted_, real = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s: sorted_.append(len(s)) or real(s))
    plain, first = suffix.repeated(pieces, length), sorted_[0]
    sorted_.clear()
    assert [x.tolist() for x in suffix.repeated(pieces, length, cores)] == [x.tolist() for x in plain]
    assert sum(map(len, plain)) > 0 and sorted_[0] < 0.6 * first
