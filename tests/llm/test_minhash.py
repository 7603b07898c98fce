import itertools
import random

import numpy as np

from millrace.llm import minhash


def texts(n=160, seed=4):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = i % 8
        if kind < 4 or not out:
            out.append([f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 120))])
        else:  # a copy with some words changed: near, borderline or far
            w = list(rng.choice(out[-30:]))
            for _ in range(max(0, kind - 4) * len(w) // 40):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
            out.append(w)
    return [" ".join(w) for w in out]


def brute(rows, threshold=0.8):
    def bag(t):
        w = (t or "").encode().lower().split()
        got = {}
        for i in range(max(1, len(w) - 4) if w else 0):
            got[tuple(w[i : i + 5])] = got.get(tuple(w[i : i + 5]), 0) + 1
        return got

    bags, up = [bag(r[1]) for r in rows], list(range(len(rows)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bags[i] and bags[j]:
            common = sum(min(c, bags[j].get(s, 0)) for s, c in bags[i].items())
            if common >= threshold * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups.values()


def test_groups_against_all_pairs(spark):
    rows = [(i, t, "x", "clash") for i, t in enumerate(texts())]
    rows += [(900, None, None, None), (901, "", None, None), (902, " \n", None, None), (903, "one two", None, None), (904, "ONE\ttwo ", None, None), (905, "one two three", None, None), (None, rows[0][1], None, None)]
    rows += [rows[5], rows[5], (906, "a b c d e f " * 20_000, None, None), (907, "a b c d e f " * 20_000 + "g", None, None)] + [(2000 + i, rows[1][1], "copy", None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_id string, keep string")
    out = minhash.near_duplicates(df.repartition(6)).collect()
    assert len(out) == len(rows) and minhash.near_duplicates(df).columns == ["doc_id", "text", "group_id", "keep"]
    kept = {}
    for r in out:
        kept.setdefault((r.group_id, (r.text or "").strip() == ""), []).append(r.keep)
    want = {}
    for group in brute(rows):
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            want[rows[i][0]] = min(ids) if ids else None
    assert {r.doc_id: r.group_id for r in out} == want
    assert all(sum(k) == 1 for (_, blank), k in kept.items() if not blank) and all(all(k) for (_, blank), k in kept.items() if blank)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_one_bucket_lose_no_link(spark):
    # one bucket of texts that were changed apart: some are linked, many are not, and no pivot links them all
    rng, rows = random.Random(9), []
    base = [f"w{i}" for i in range(120)]
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"y{i}_{rng.randint(0, 99)}"
        rows.append((i, " ".join(w + ["again and again"] * rng.randint(0, 3))))
    ids = {t: f"{i:03d}" for i, t in rows}
    placed = spark.createDataFrame([(ids[t], key, ids[t]) for _, t in rows for key in (7, 8)] + [("070", 9, "070"), ("071", 9, "070")], "id string, key long, component string")
    wanted = spark.createDataFrame([(ids[t], t) for _, t in rows] + [("070", "far away"), ("071", "far away too")], "id string, text string")
    want = sorted(sorted(f"{i:03d}" for i in g) for g in brute(rows) if len(g) > 1)
    for block, side in ((256, 8), (8, 2), (8, 8), (4, 3)):
        up = {}
        find = lambda x: x if up.get(x, x) == x else find(up[x])  # noqa: B023, E731
        ties = minhash._between(placed, wanted, 0.8, 5, block=block, side=side).collect()
        assert len(ties) <= 70 * 10
        for r in ties:
            up[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
        groups = {}
        for i in ids.values():
            groups.setdefault(find(i), []).append(i)
        assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == want


def test_columns_that_clash_or_cannot_be_compared(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", {"k": 1}), (1, "a b c d e f", "x", {"k": 2}), (2, "a b c d e f", None, None), (None, None, None, {})], "doc_id long, text string, component string, m map<string,int>")
    out = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.group_id or 0, r.keep) for r in out) == [(0, 0, True), (1, 1, False), (1, 1, True), (2, 1, False)]


def test_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**63, 120).astype(np.uint64))
    for scale in (0.9, 0.5, 0.2):
        a, b = rng.uniform(0.1, 3, 120), rng.uniform(0.1, 3, 120) * scale
        sig = minhash.signatures([(keys, a), (keys[:100], b[:100])], 4096)
        assert abs((sig[0] == sig[1]).mean() - minhash.similarity((keys, a), (keys[:100], b[:100]))) < 0.03


def test_signature_does_not_depend_on_neighbours():
    sets = [minhash.shingles(t.encode()) for t in texts(12)]
    together = minhash.signatures(sets, 64)
    assert all((minhash.signatures([s], 64)[0] == together[i]).all() for i, s in enumerate(sets))
