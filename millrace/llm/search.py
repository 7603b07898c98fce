"""Ranked search by words with upper bounds from hashed sketches of maxima.

A document's impact for a term is what the term adds to the score of a query that has it. The impacts of the asked terms fold into a sketch of 1024
numbers: each holds the maximum of the impacts whose terms hash there. The sum of a sketch at the places of a query's terms is never below the true
score, and a product of matrices gives it for all documents of a batch and all queries at once. Documents are then scored exactly in falling order of
their bounds until a bound is below the least score that is still among the best.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, cut, discard, folded, read_table

NAME = "op13_lexical_search"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLACES = 1024
BEST = 10
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BATCH, _STEP = 1024, 32


def terms_of(text: bytes | None) -> Counter:
    found: Counter = Counter()
    for words in folded(text, _LETTERS):
        found.update(words)
    return found


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: how many it has in all, and those of the vocabulary, in ascending order of their number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        asked = numbers.keys()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                ids, total, flat, counts, ends = [], [], [], [], [0]
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                    found = terms_of(text.as_py())
                    if found:
                        own = sorted((numbers[t], found[t]) for t in found.keys() & asked)
                        ids.append(doc_id)
                        total.append(found.total())
                        flat += [t for t, _ in own]
                        counts += [c for _, c in own]
                        ends.append(len(flat))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((flat, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Best:
    """The best documents of each query so far: score first, then the smaller doc_id, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(queries)], np.ones(queries)

    def add(self, q: int, scores: np.ndarray, ids: list) -> None:
        more = [(-int(s), i is None, i or 0) for s, i in zip(scores, ids, strict=True) if s >= self.least[q]]
        if more:
            self.rows[q] = sorted(self.rows[q] + more)[: self.k]
            if len(self.rows[q]) == self.k:
                self.least[q] = -self.rows[q][-1][0]


def sketches(doc: np.ndarray, place: np.ndarray, impact: np.ndarray, docs: int, places: int) -> np.ndarray:
    """docs x places: the largest impact that falls to each place."""
    out = np.zeros((docs, places))
    np.maximum.at(out, (doc, place), impact)
    return out


def best_in(batches: Iterator[pa.RecordBatch], queries: list[np.ndarray], weights: np.ndarray, places: np.ndarray, docs: int, length: int, k: int, width: int = PLACES) -> Best:
    """The best documents of postings for queries, each the numbers of its terms."""
    best = Best(len(queries), k)
    asked = np.zeros((width, len(queries)))  # how many of a query's terms hash to a place
    for q, terms in enumerate(queries):
        np.add.at(asked[:, q], places[terms], 1)
    mine = np.zeros(len(weights), bool)
    for whole in batches:
        for lo in range(0, whole.num_rows, _BATCH):
            b = whole.slice(lo, _BATCH)
            ids, terms, tf = b.column(0).to_pylist(), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            size = b.column(2).value_lengths().to_numpy()
            m = np.array([100 - 90 + (90 * n * docs) // length for n in b.column(1).to_pylist()], np.int64)  # in whole numbers of any size
            doc, starts = np.repeat(np.arange(len(ids)), size), np.cumsum(size) - size
            impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            bounds = sketches(doc, places[terms], impact, len(ids), width) @ asked  # whole numbers below 2 ** 53, so the sums are exact
            for q in np.flatnonzero(bounds.max(0) >= best.least):
                bound = bounds[:, q]
                order = np.flatnonzero(bound >= best.least[q])
                order = order[np.argsort(-bound[order], kind="stable")]
                mine[queries[q]] = True
                for at in range(0, len(order), _STEP):
                    some = order[at : at + _STEP]
                    if bound[some[0]] < best.least[q]:
                        break
                    count = size[some]
                    of = np.repeat(np.arange(len(some)), count)
                    cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[some], count)
                    hit = mine[terms[cell]]
                    best.add(q, np.bincount(of[hit], impact[cell[hit]], minlength=len(some)), [ids[i] for i in some])
                mine[queries[q]] = False
    return best


def _blocks(items: DataFrame, most_items: int, most_terms: int) -> Iterator[list[tuple]]:
    """(item_id, terms) of all items, in blocks of at most so many items and terms (one item may have more terms)."""
    held, size = [], 0
    for row in items.select(F.col("item_id"), F.col("text").cast("string").cast("binary").alias("text")).toLocalIterator():
        terms = sorted(terms_of(row.text))
        if held and (len(held) == most_items or size + len(terms) > most_terms):
            yield held
            held, size = [], 0
        held.append((row.item_id, terms))
        size += len(terms)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = BEST, most_items: int = 2048, most_terms: int = 100_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each row of items (item_id, text).

    The queries are taken in blocks, each against all documents. Items without a term, or whose terms no document has, get no row; an item that occurs
    twice is answered twice; equal scores rank by the smaller doc_id, null ids last; repeated documents are ranked one by one; other columns do not
    matter; empty tables give no rows.
    """
    spark, out = docs.sparkSession, None
    item_type = items.schema["item_id"].dataType.simpleString()
    for block in _blocks(items, most_items, most_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        index = cut(postings(docs, vocabulary))
        total, length = index.agg(F.count("*"), F.sum("n")).first()
        holders = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holders[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in holders], np.int64)
        places = np.array([zlib.crc32(t) % PLACES for t in vocabulary], np.int64)
        queries = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in block]
        shared = spark.sparkContext.broadcast((queries, weights, places, total, length))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = best_in(batches, *shared.value, k)
            rows = [(q, None if none else i, -s) for q, own in enumerate(best.rows) for s, none, i in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["q", "doc_id", "score"])

        found = index.mapInArrow(run, "q int, doc_id long, score long").withColumn("part", F.spark_partition_id() % 64)
        # first among some tasks, then among all
        for by in (["q", "part"], ["q"]):
            rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            found = found.withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q int, item_id {item_type}")
        answers = cut(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
        discard(index)
        out = answers if out is None else out.unionByName(answers)
    return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long") if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
sized AS (SELECT r, doc_id, len(terms)::HUGEINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::HUGEINT AS docs, sum(n) AS length FROM sized),
asked AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark))),
tf AS (SELECT r, term, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w FROM tf GROUP BY term),
m AS (SELECT r, doc_id, 100 - 90 + (90 * n * docs) // length AS m FROM sized, total),
scored AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
