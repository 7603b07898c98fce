"""How far the sources of a language differ in their words, from bitmaps of count levels.

The kept terms of a language are numbered by falling count and cut into chunks of 64. In a chunk each (source, count) has a bitmap of the terms that
occur so often there, and a source's terms that do not occur at all are the complement of its other bitmaps. The AND of two sources' bitmaps has as
many bits as there are terms with just these two counts; each such cell weighs the same, so a pair's divergence is the sum over cells of bits times
the difference of the two shares. Terms of like counts stand side by side, so most sources need a few bitmaps a chunk instead of 64 numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, cut, folded, read_table

NAME = "op12_source_divergence"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP, SCALE, SPARE = 30, 50, 1_000_000_000, 5
_CHUNK_BITS, _RANGE_BITS, _BLOCK = 6, 12, 64
_ENTRIES, _TILE = 250_000, 1 << 21
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term binary, n, docs): occurrences and documents of each term, summed over some documents of a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                names = list(n)
                columns = [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in names], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                n, d = held[lang, source]
                size -= len(n)
                seen: set[bytes] = set()
                for words in folded(text.as_py(), _LETTERS):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                size += len(n)
                if size > _ENTRIES:
                    yield from flush()
                    size = 0
        yield from flush()

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(n: Column, total: Column, kinds: Column) -> Column:
    """The share of a term, in exact numbers of any size; null where there is no term at all."""
    below = total.cast("decimal(26,0)") + F.lit(SPARE).cast("decimal(1,0)") * kinds.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + F.lit(SPARE).cast("decimal(1,0)"))
    return F.when(below > 0, F.lit(1).cast("long") + F.call_function("div", above, F.greatest(below, F.lit(1).cast("decimal(27,0)"))))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of one language's terms: (lang, a, b, value) of each pair of sources, from two blocks or from within one."""
    t = pa.Table.from_batches(list(batches))
    lang, first, second = (t[c][0].as_py() for c in ("lang", "i", "j"))
    chunk, p, bits = t["chunk"].to_numpy(), t["p"].to_numpy(), t["bits"].to_numpy().view(np.uint64)
    code = t["source"].combine_chunks().dictionary_encode()
    names, source = code.dictionary.to_pylist(), code.indices.fill_null(-1).to_numpy()
    if len(names) < 2:  # blocks without sources, or a language of one
        return
    head = np.flatnonzero((chunk == -1) & (source >= 0))  # a row for each source: its block and its share of an absent term
    zero, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    zero[source[head]], block[source[head]] = p[head], t["block"].to_numpy()[head]
    value = np.zeros((len(names), len(names)), np.int64)
    body = np.flatnonzero(chunk != -1)
    body = body[np.argsort(chunk[body], kind="stable")]
    for rows in np.split(body, np.flatnonzero(np.diff(chunk[body])) + 1) if len(body) else []:
        own = rows[source[rows] >= 0]
        mask = np.bitwise_or.reduce(bits[rows[source[rows] < 0]])
        some = np.zeros(len(names), np.uint64)
        np.bitwise_or.at(some, source[own], bits[own])
        # with the terms that a source lacks as one more level, by complement
        level_of = np.concatenate([source[own], np.arange(len(names))])
        order = np.argsort(level_of, kind="stable")
        level_bits, level_p = np.concatenate([bits[own], mask & ~some])[order], np.concatenate([p[own], zero])[order]
        starts = np.searchsorted(level_of[order], np.arange(len(names)))
        sums = np.empty((len(order), len(names)), np.int64)
        step = max(1, _TILE // len(order))
        for lo in range(0, len(order), step):
            joint = np.bitwise_count(level_bits[lo : lo + step, None] & level_bits[None, :])
            sums[lo : lo + step] = np.add.reduceat(joint * np.abs(level_p[lo : lo + step, None] - level_p[None, :]), starts, axis=1)
        value += np.add.reduceat(sums, starts, axis=0)
    a, b = np.triu_indices(len(names), 1)
    swap = np.array([names[i] > names[j] for i, j in zip(a, b, strict=True)], bool)  # a pair is named alike in all ranges
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    wanted = (np.minimum(block[a], block[b]) == first) & (np.maximum(block[a], block[b]) == second)
    a, b = a[wanted], b[wanted]
    yield pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(a), pa.string()), pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array(value[a, b])], names=["lang", "a", "b", "value"]
    )


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = _BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    part `pair`: for each source of a language how far each other source is from it over all kept terms (those in at least least_docs of the language's
    documents), the farthest first; 0 where no term is kept. part `term`: the `top` kept terms whose share is most above that in the whole language.
    Null texts, languages and sources are read as ''; repeated rows are documents of their own; of equal values the lesser item comes first; other
    columns of docs do not matter; an empty table gives no rows. A source's list within a term has one entry a source of the language, as each of its
    parts of the result has.
    """
    docs = docs.select("lang", "source", "text")
    # one exchange by (lang, term) serves the sums by source and those over all sources
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", F.col("term").cast("string").alias("term"), "total", "by"))
    # each row knows its place in the order by count: partition and place within it
    order = ["lang", F.desc("total"), "term"]
    placed = cut(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))

    langs = placed.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = placed.select("lang", F.inline("by")).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    blocks = F.ceil(F.col("sources") / block)
    widths = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").join(widths, "lang")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("group_n", "v", "lang_n")], blocks.alias("blocks"))
    groups = cut(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))))

    bit = F.expr(f"shiftleft(1L, cast(id & {(1 << _CHUNK_BITS) - 1} AS int))")
    chunk, range_ = F.shiftright("id", _CHUNK_BITS).alias("chunk"), F.shiftright("chunk", _RANGE_BITS - _CHUNK_BITS).alias("range")
    levels = placed.select("lang", chunk, bit.alias("bit"), F.inline("by")).groupBy("lang", "chunk", "source", "n").agg(F.bit_or("bit").alias("bits"))
    levels = levels.join(groups, ["lang", "source"]).select("lang", range_, "chunk", "source", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), "bits", "block", "blocks")
    masks = placed.select("lang", chunk, bit.alias("bit")).groupBy("lang", "chunk").agg(F.bit_or("bit").alias("bits")).join(groups.select("lang", "blocks").distinct(), "lang")
    ranges = masks.select("lang", range_).distinct()
    absent = F.coalesce(share(F.lit(0), F.col("group_n"), F.col("v")), F.lit(0).cast("long"))
    heads = groups.join(ranges, "lang", "left").select("lang", F.coalesce("range", F.lit(-1).cast("long")).alias("range"), F.lit(-1).cast("long").alias("chunk"), "source", absent.alias("p"), F.lit(0).cast("long").alias("bits"), "block", "blocks")
    both = F.expr("transform(sequence(0L, blocks - 1), x -> struct(least(x, block) AS i, greatest(x, block) AS j))")
    every = F.expr("flatten(transform(sequence(0L, blocks - 1), x -> transform(sequence(x, blocks - 1), y -> struct(x AS i, y AS j))))")
    masks = masks.select("lang", range_, "chunk", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("p"), "bits", F.lit(-1).cast("long").alias("block"), every.alias("to"))
    tasks = levels.unionByName(heads).withColumn("to", both).drop("blocks").unionByName(masks)
    tasks = tasks.select("lang", "range", "chunk", "source", "p", "bits", "block", F.inline("to"))
    found = tasks.groupBy("lang", "range", "i", "j").applyInArrow(_pairs, "lang string, a string, b string, value long")
    found = cut(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = found.select("lang", "value", ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    shares = placed.select("lang", F.col("term").alias("item"), "total", F.inline("by")).join(groups, ["lang", "source"])
    above = share(F.col("n"), F.col("group_n"), F.col("v")) - share(F.col("total"), F.col("lang_n"), F.col("v"))
    terms = shares.select("lang", "source", F.lit("term").alias("part"), "item", above.alias("value")).where("value > 0")
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", ranked).unionByName(terms.select("*", ranked).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY ALL),
s AS (SELECT c.lang, c.source, sum(c.n) AS group_n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SPARE})) // (coalesce(s.group_n, 0) + {SPARE} * v.v) AS p,
  1 + ({SCALE}::HUGEINT * (k.total + {SPARE})) // (v.lang_n + {SPARE} * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
