import numpy as np
import pytest

from millrace.llm import ann, neardup_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, n_links long, cell string"


def vectors(spark, n=500, width=12, seed=0, unit=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for i in range(60):  # chains and clusters of near copies
        x[i + 100] = x[i % 7] + 0.1 * rng.normal(size=width)
    x[200:215] = x[3]  # exact copies
    x[300:305] = 2.5 * x[3]
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), [float(v) for v in r.astype(np.float32)], 1, "clash", 5, None) for i, r in enumerate(x)]
    bad = [None, [0.0] * width, [float("nan")] * width, [None] + [1.0] * (width - 1), [float("inf")] + [0.0] * (width - 1), []]
    rows += [(10_000 + 20 * i, b, None, None, None, None) for i, b in enumerate(bad)] + [(20_000, [1.0, 0.0], None, None, None, None), (20_001, [1.0, 0.01], None, None, None, None), (None, rows[0][1], None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def good(rows):
    return [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(r[1])]


def test_links_and_components_against_brute_force(spark):
    df, rows = vectors(spark, unit=False)
    held = good(rows)
    links = {v: 0 for v, _ in held}
    comp = {v: v for v, _ in held}
    pairs = [(a, b) for i, (a, x) in enumerate(held) for b, y in held[i + 1 :] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        lo, hi = sorted((comp[a], comp[b]))
        comp = {k: lo if c == hi else c for k, c in comp.items()}
    for block, tile, side in ((4096, 256, 8), (32, 8, 8), (32, 8, 2), (20, 8, 3)):
        out = neardup_vectors.near_duplicates(df, block=block, tile=tile, side=side).collect()
        assert len(out) == len(rows)
        for r in out:
            if r.vec_id is not None:
                assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), comp.get(r.vec_id, r.vec_id), comp.get(r.vec_id, r.vec_id) == r.vec_id), r
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0
    assert neardup_vectors.near_duplicates(df.where("vec_id = 10000")).count() == 1


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_scores(spark, unit):
    df, rows = vectors(spark, 1500, 24, 5, unit)
    held = good(rows)
    out = ann.nearest(df.where("vec_id % 20 = 0"), ann.index(df, shard_rows=500)).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r)
    hits = total = 0
    known = dict(held)
    for q, x in held:
        if q % 20:
            continue
        want = sorted((-float(y @ x), v) for v, y in held if v != q and len(y) == len(x))[:20]
        got = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(want) + 1)) and q not in [r.vec_id for r in got]
        assert all(abs(r.score - known[r.vec_id] @ x) < 1e-9 for r in got) and [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += len({v for _, v in want} & {r.vec_id for r in got})
        total += len(want)
    assert hits >= 0.95 * total and {q for q in by} == {v for v, _ in held if v % 20 == 0}
    assert [r.vec_id for r in by[20_000]] == [20_001]


def test_few_and_no_vectors(spark):
    df, _ = vectors(spark, 320, 8)
    few = df.where("vec_id < 12")
    assert ann.nearest(few.where("vec_id = 0"), ann.index(few)).count() == 11
    assert ann.nearest(df.limit(0), ann.index(df.limit(0))).count() == 0
    # copies beyond k: the smaller ids win
    same = df.where("vec_id BETWEEN 200 AND 214")
    assert [r.vec_id for r in ann.nearest(same.where("vec_id = 205"), ann.index(same, k=5), k=5).orderBy("rank").collect()] == [200, 201, 202, 203, 204]
