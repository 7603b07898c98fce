import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import mix, pack, shard, urls

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, size string, shard string"


def docs(spark, n=400):
    rows = []
    for i in range(n):
        text = None if i % 37 == 0 else "" if i % 41 == 0 else " ".join(f"Wörd{(i * 7 + k) % 50} 日本\n" for k in range(i % 60)) + ("x" * 9000 if i == 5 else "")
        rows.append((i, text, "en", None if i % 11 == 0 else "big" if i % 3 else f"s{i % 4}", "clash", "clash"))
    rows += [rows[7]] * 5 + [(None, "null id", None, "s1", None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def expected_targets(sizes, max_epochs=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, cap = {s: i % 3 + 1.0 for i, s in enumerate(order)}, {s: max_epochs * sizes[s] for s in sizes}
    capped, total = set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(cap[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if weight[s] * level > cap[s] + 1e-9]
        if not over:
            return {s: cap[s] if s in capped else weight[s] * level for s in order}
        capped.update(over)


def test_mix_meets_targets(spark):
    df, rows = docs(spark, 3000)
    out = mix.mix_sources(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(out) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    want = expected_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source]) and r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 8 * largest[s], (s, taken[s], t)
    assert sorted(map(str, out)) == sorted(map(str, mix.mix_sources(df.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))


def test_mix_capped_sources_and_empty(spark):
    df = spark.createDataFrame([(i, "a b c d", s) for i, s in enumerate("a" * 300 + "b" * 3 + "c" * 3)] + [(999, None, "d")], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mix.mix_sources(df).select("source", "target").distinct().collect()}
    assert got == pytest.approx({"a": 1224 - 72, "b": 36.0, "c": 36.0, "d": 0.0})
    assert mix.mix_sources(df.limit(0)).count() == 0
    copies = mix.mix_sources(df).agg({"copies": "sum"}).first()[0]
    assert mix.take(df).count() == copies and mix.take(df).columns == df.columns


def test_shards_are_even_and_match_the_mixture(spark):
    df, rows = docs(spark, 1200)
    out = shard.shard(df, 24).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    counts = Counter(r[3] for r in rows)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for k, held in by.items():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        for s, n in counts.items():
            assert abs(sum(r.source == s for r in held) - n / 24) <= 2, (k, s)
    sizes = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sizes == Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    again = shard.shard(df.repartition(5), 24, slices=7).select("doc_id", "shard")
    assert len(again.collect()) == len(rows)
    assert sorted(map(str, shard.shard(df.repartition(3), 24).collect())) == sorted(map(str, out))


def test_shard_order_is_the_interleaving(spark):
    df, _ = docs(spark, 300)
    out = shard.shard(df, 3).collect()
    place = sorted(out, key=lambda r: (r.shard, r.slot))
    seen, total, last = Counter(), Counter(r.source for r in out), 0.0
    for r in place:
        seen[r.source] += 1
        f = (seen[r.source] - 0.5) / total[r.source]
        assert f >= last - 1e-12
        last = f


def test_shard_few_and_no_rows(spark):
    df, _ = docs(spark, 50)
    assert Counter(r.shard for r in shard.shard(df.limit(3), 24).collect()).most_common(1)[0][1] == 1
    assert shard.shard(df.limit(0), 24).count() == 0


def test_pack_round_trip(spark):
    df, rows = docs(spark, 300)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    df = df.union(spark.createDataFrame([(9001, "a <|endoftext|> b<|startoftext|>c", None, None, None, None), (9002, "é é  x y \x1c z", None, None, None, None)], SCHEMA))
    tok = tokenizers.Tokenizer.from_file(path)
    want = sorted((r.doc_id is None, r.doc_id or 0, tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.collect())
    out = pack.pack(pack.tokenize(df, path, capacity=64), capacity=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        ids = list(memoryview(r.ids).cast("I"))
        assert len(ids) == r.length <= 64 and r.start == r.piece * 64
        by_doc[r.doc_id].append((r.piece, ids))
        by_seq[r.sequence_id].append((r.offset, r.length))
    got = []
    for d, held in by_doc.items():
        copies = sum(p == 0 for p, _ in held)
        ids = [x for p, part in sorted(held) for x in (part if copies == 1 else [])] if copies == 1 else next(part for p, part in held)
        got += [(d is None, d or 0, ids)] * copies
    assert sorted(got) == want
    for held in by_seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    bound = math.ceil(sum(r.length for r in out) / 64)
    assert len(by_seq) <= bound * 1.02 + 1
    assert pack.pack(pack.tokenize(df.limit(0), path)).count() == 0


def best_bins(sizes, capacity):
    """Brute force: the least number of bins."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in sorted({b: k for k, b in enumerate(bins)}.values()):
            if bins[k] >= sizes[i]:
                place(i + 1, [b - sizes[i] * (j == k) for j, b in enumerate(bins)])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_plan_bins_against_brute_force():
    import random

    rng, worse = random.Random(3), 0
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 9))]
        bins = pack.plan_bins(Counter(sizes), 20)
        assert Counter(n for t, f in bins for n in f for _ in range(t)) == Counter(sizes) and all(sum(f) <= 20 for _, f in bins)
        worse += sum(t for t, _ in bins) - best_bins(sizes, 20)
    assert worse <= 1


def test_plans_of_lengths_that_fit_badly_together():
    rng = random.Random(1)
    sizes = Counter(rng.randint(1300, 1500) for _ in range(4500))
    bins = pack.plan_bins(sizes)
    used = Counter()
    for times, filling in bins:
        assert sum(filling) <= 4096
        for n in filling:
            used[n] += times
    assert used == sizes and sum(t for t, _ in bins) <= 1807


def test_best_fit_on_a_histogram_is_best_fit_piece_by_piece():
    rng = random.Random(4)
    for _ in range(60):
        sizes = Counter(rng.randint(1, rng.choice([9, 50, 100])) for _ in range(rng.randint(1, 150)))
        rooms = []
        for n in sorted(sizes.elements(), reverse=True):
            room = min((r for r in rooms if r >= n), default=100)
            rooms = [*rooms, room - n]
            if room in rooms[:-1]:
                rooms.remove(room)
        plan = pack._best_fit(sizes, 100)
        assert sum(t for t, _ in plan) == len(rooms) and sum((Counter({n: t * f.count(n) for n in set(f)}) for t, f in plan), Counter()) == sizes
        even = pack._even(sizes, 100, most=200)
        assert sum((Counter({n: t * f.count(n) for n in set(f)}) for t, f in even), Counter()) == sizes and all(sum(f) <= 100 for _, f in even)


def test_columns_that_cannot_be_hashed(spark):
    df = spark.createDataFrame([(1, 5, {"a": 1}), (1, 5, {"a": 2}), (2, 9, None)], "doc_id long, length long, m map<string,int>")
    out = pack.pack(df, capacity=10).collect()
    assert len(out) == 3 and len({r.sequence_id for r in out}) == 2 and sorted(r.offset for r in out) == [0, 0, 5]


def test_plan_bins_mixes_lengths():
    """Room that one length alone fills badly is filled by different ones, and further lengths than the longest few are looked at."""
    for sizes, most in (({3000: 900, 700: 900, 600: 900, 496: 900}, 1080), ({2000: 9000, 1900: 9000, 1200: 9000, 896: 9000}, 13500)):
        bins = pack.plan_bins(sizes)
        held = Counter()
        for t, f in bins:
            held.update({n: t * k for n, k in Counter(f).items()})
            assert sum(f) <= pack.CAPACITY
        assert held == Counter({n: c for n, c in sizes.items() if c}) and sum(t for t, _ in bins) <= most
    # an exact filling whose longest piece comes after thirty others that fit
    assert pack.plan_bins({2000: 1, **{n: 1 for n in range(1501, 1561, 2)}, 1400: 1, 696: 1})[0] == (1, [2000, 1400, 696])


def test_urls_rules_and_aliases(spark):
    link = '<html><LINK href="{}" rel="canonical"></html>'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "https://A.Example.COM/en/7x?q#f", None), (2, "http://example.com/en/8", ""), (3, "http://xexample.com/en/7", None), (4, None, link.format("http://a.com/en/")), (5, "no-scheme.com/en/", None),
        (6, "http://m.example.net/de/81", None), (7, "http://m.example.net/de/7", None), (8, "http://q.edu/a", link.format("http://q.com/en/b")), (9, "http://r.edu/", refresh.format("http://q.edu/a")),
        (10, "http://s.edu/", link.format("http://r.edu/")), (11, "http://ok.edu/", link.format("http://bad.com/en/1")), (12, "http://ok.edu/2", link.format("http://ok.edu/")), (13, "http://ok.edu/2", link.format("http://u.example.com/en/7")),
        (14, "http://com/en/", None), (15, "http://x.org?a=/es/", None), (16, "http://x.org/es/", link.format("/relative")), (17, "http://t.edu/", None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, verdict string")
    redirects = spark.createDataFrame([("http://t.edu/", "http://z.org/es/"), (None, "x")], "url string, other string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, redirects=redirects).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block") and got[3][2:] == ("com/en/", "block")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == ("net/de/", "allow")
    assert [got[i][2:] for i in (8, 9, 10)] == [(None, "block")] * 3, "a block reaches all aliases"
    assert [got[i][2:] for i in (11, 12, 13)] == [(None, "allow")] * 3, "an allowed alias wins"
    assert got[14][2:] == ("com/en/", "block") and got[15] == ("x.org", "", None, "allow") and got[16][2:] == ("org/es/", "block") and got[17][3] == "block"
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_with_several_tags(spark):
    """Links after one to the page itself, a relative one or another link count; so does the first target of a tag."""
    own, bad, good = ('<link rel="canonical" href="{}">'.format(u) for u in ("http://a.edu/1", "http://bad.com/en/1", "http://u.example.com/en/7"))
    refresh = "<META content='0; url={}' http-equiv=refresh >".format
    rows = [
        (1, "http://a.edu/1", own + bad), (2, "http://a.edu/2", '<link rel="canonical" href="/x">' + bad), (3, "http://a.edu/3", bad.replace("/1", "/3") + "<p>" + good),
        (4, "http://a.edu/4", refresh("/x") + refresh("http://a.edu/4") + refresh("http://bad.com/en/4")), (5, "http://a.edu/5", '<link rel=stylesheet href="http://bad.com/en/5"><link rel=canonical>'),
        (6, "http://a.edu/6", '<link rel=canonical href="http://bad.com/en/6" data-href="/y">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: (r.verdict, r.by) for r in urls.judge(df).collect()} == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "alias"), 4: ("block", "alias"), 5: ("allow", "default"), 6: ("block", "alias")}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute(urls.ORACLE_SQL).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect())


def test_urls_relative_targets_and_chains(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://r.com/a", link("/en/8")), (2, "https://s.edu/x/y?q", link("//t.com/en/1")), (3, "http://org/es/p", link("q#f")), (4, "http://v.com/en/", link("?a=1&amp;b=2")), (5, "http://w.com", link("en/1")),
        (6, "http://x.edu/1", link("#top") + link("mailto:me@y.com/en/") + link("")), (7, "nowhere", link("/en/8")), (8, "http://y.edu/a?b/c", link("d")), (9, "http://y.edu/d", link("http://z.com/en/9?a=1&amp;b=2")), (10, "http://z.com/en/9?a=1&b=2", None),
    ]
    rows += [(100 + i, f"http://chain.edu/{i}", link(str(i + 1))) for i in range(40)] + [(140, "http://chain.edu/40", link("http://end.com/en/1"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = {(r.url, r.other) for r in urls.links(df.where("page_id < 11")).collect()}
    assert made == {
        ("http://r.com/a", "http://r.com/en/8"), ("https://s.edu/x/y?q", "https://t.com/en/1"), ("http://org/es/p", "http://org/es/q"), ("http://v.com/en/", "http://v.com/en/?a=1&b=2"), ("http://w.com/", "http://w.com/en/1"),
        ("http://y.edu/a?b/c", "http://y.edu/d"), ("http://y.edu/d", "http://z.com/en/9?a=1&b=2"),
    }
    got = {r.page_id: (r.verdict, r.by) for r in urls.judge(df).collect()}
    assert [got[i] for i in (1, 2, 5, 8, 9)] == [("block", "alias")] * 5 and got[6] == got[7] == ("allow", "default") and all(got[100 + i] == ("block", "alias") for i in range(41))
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(urls.ORACLE_SQL).fetchall()) == sorted(tuple(r) for r in urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect())


FORMS = [  # url, html, the links it makes
    ("https://a.com/x/y/p", '<link rel="canonical" href="../../q">', ["https://a.com/q"]),
    ("https://b.com/x/y/", '<link rel="canonical" href="./../../../z/./w/..">', ["https://b.com/z/"]),
    ("https://c.com/x", '<link rel="canonical" href="//c.com/a/../b?p=../q">', ["https://c.com/b?p=../q"]),
    ("https://d.com/1", "<link rel='alternate canonical' href='/2'><link rel=\"Canonical nofollow\" href='/3'>", ["https://d.com/2", "https://d.com/3"]),
    ("https://e.com/1", "<link rel='alternate' href='/canonical'><link rel='not-canonical' href='/4'><link rel=canonicals href='/5'><link data-rel=canonical href='/6'>", []),
    ("https://f.com/1", '<base target="_top"><base href="/deep/er/"><base href="http://no.com/"><link rel=canonical href="7">', ["https://f.com/deep/er/7"]),
    ("https://g.com/1", '<base href="https://com/en/"><meta http-equiv=refresh content="0; URL=8">', ["https://com/en/8"]),
    ("https://h.com/1", '<base href="mailto:x"><link href="9#part" rel=canonical>', ["https://h.com/9"]),
    ("https://i.com/1#here", '<link rel=canonical href="https://i.com/1">', []),
    ("HTTPS://J.com", '<link rel=canonical href="http://J.COM/P">', ["http://j.com/P"]),
    ("https://k.com/1", '<link rel=canonical data-href="/no" href=" /k?a=1&#38;b&#x3D;2&amp;#47; ">', ["https://k.com/k?a=1&b=2&#47;".split("#")[0]]),
    ("https://l.com/a/..", '<link rel=canonical/ href=http&#58;&#x2F;&#47;l.com>', ["http://l.com/"]),
]


def test_urls_forms_of_links(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(FORMS)], "page_id long, url string, html string")
    nodes = {"HTTPS://J.com": "https://j.com/", "https://l.com/a/..": "https://l.com/"}
    assert {(r.url, r.other) for r in urls.links(df).collect()} == {(nodes.get(u, u), other) for u, _, made in FORMS for other in made}


def test_urls_decisions_reach_nodes(spark):
    """Decisions reach urls that are written otherwise, and those that a .. or a base leads to."""
    link = '<link rel="x canonical" href="{}">'.format
    rows = [
        (1, "http://a.edu/x/y/p", link("../../q")), (2, "http://a.edu/q#top", link("http://bad.com/en/1")), (3, "HTTP://A.EDU/q", None), (4, "http://b.edu/1", '<base href="http://u.example.com/en/">' + link("7")), (5, "http://b.edu/1#a", None),
        (6, "http://c.edu", link("http://org/es/../d")), (7, "http://c.edu/", link("http://org/d/../es/")), (8, "a b#c", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.by) for r in urls.judge(df).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "alias"), 5: ("allow", "alias"), 6: ("block", "alias"), 7: ("block", "alias"), 8: ("allow", "default")}
    # the SQL says the same of these pages and of all forms, each leading to a rule of its own
    rows += [(10 + i, u, h) for i, (u, h, _) in enumerate(FORMS)] + [(100 + i, u, link(f"http://{('com/en', 'org/es')[i % 2]}/{i}")) for i, u in enumerate(sorted({o for *_, made in FORMS for o in made}))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = pytest.importorskip("duckdb").connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(con.execute(urls.ORACLE_SQL).fetchall(), key=str)
    assert want == sorted((tuple(r) for r in urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert sum(r[4] == "block" for r in want) > 20
    redirects = spark.createDataFrame([("http://d.edu/#f", "http://COM/x/../en/")], "url string, other string")
    assert urls.judge(spark.createDataFrame([(9, "http://D.edu", None)], df.schema), redirects=redirects).first().verdict == "block"


def test_clashing_columns_and_rows_without_ids(spark):
    rows = [(None, f"one two {i}", "s", i, 1) for i in range(400)] + [(1, "a b c", "t", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epochs int, rest int")
    out = mix.mix_sources(df, weights=(1.0, 400.0)).collect()
    assert len(out) == 401 and {r.epochs for r in out} == {*range(400)}
    taken, target = sum(r.taken for r in out if r.source == "s"), next(r.target for r in out if r.source == "s")
    assert abs(taken - target) <= 3 and len({r.copies for r in out if r.source == "s"}) == 2, "rows without an id have fates of their own"
    pieces = spark.createDataFrame([(1, 5, "x", 9), (2, 7, "y", 9)], "doc_id long, length long, offset string, sequence_id int")
    packed = pack.pack(pieces, capacity=12)
    assert sorted(packed.columns) == ["doc_id", "length", "offset", "sequence_id"] and sorted(r.offset for r in packed.collect()) == [0, 7]


def test_shard_places_against_sorting(spark):
    """The same places as sorting by fractional rank on one machine gives."""
    rows = [(i if i % 9 else None, "x" * (i % 40), None if i % 5 == 0 else "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.select("source", "doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), (F.length("text") + 8).alias("size")).withColumn("h", F.xxhash64(F.lit(11), "doc_id", "crc", F.col("size").cast("long")).bitwiseAND((1 << 32) - 1)).collect()
    first = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731  nulls first
    ranked = []
    for source in {r.source for r in hashed}:
        own = sorted((r for r in hashed if r.source == source), key=lambda r: (r.h, first(r.doc_id), r.crc, r.size))
        ranked += [((i + 0.5) / len(own), (source is not None, source or ""), r.h, first(r.doc_id), r) for i, r in enumerate(own)]
    ranked.sort(key=lambda x: x[:4])
    want = sorted((str(r.doc_id), r.size, (g * 7 + 6) // 300, g - ((g * 7 + 6) // 300 * 300) // 7) for g, (*_, r) in enumerate(ranked))
    for slices in (1, 5, None):
        assert sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in shard.shard(df, shards=7, slices=slices).collect()) == want
