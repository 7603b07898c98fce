"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct terms of a text: beside each term's own weight, every pair of terms
has one, through short vectors, so that an insult next to the mention of a group can weigh more than both apart. Terms are words and the first
characters of words, hashed to a fixed number of places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import give_back, lean, read_table

NAME = "op3_toxicity"
BITS, PREFIXES = 18, (3, 4, 5)
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CACHE_WORDS = 100_000
_known: dict[bytes, tuple[int, ...]] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(word: bytes) -> tuple[int, ...]:
    """The places of a word and of its prefixes; a place depends on the term alone."""
    word = word.strip(_EDGES)
    text = word.decode("utf-8", "replace")
    found = [b"w" + word] if word else []
    found += [b"p%d" % n + text[:n].encode() for n in PREFIXES if len(text) >= n]
    return tuple(zlib.crc32(t) & ((1 << BITS) - 1) for t in found)


def terms_of(text: bytes | None) -> np.ndarray:
    """The distinct places of a whole text, in ascending order; empty for null."""
    words = set((text or b"").lower().split())
    if len(_known) > _CACHE_WORDS:
        _known.clear()
    got: set[int] = set()
    for w in words:
        t = _known.get(w)
        if t is None:
            t = _known[w] = _terms(w)
        got.update(t)
    return np.array(sorted(got), dtype=np.int32)


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray  # one for each place
    factors: np.ndarray  # places x dimensions

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        """The probability of label 1 for each set of terms."""
        return 1 / (1 + np.exp(-np.clip(self.logits(terms)[0], -40, 40)))

    def logits(self, terms: list[np.ndarray]):
        at = np.concatenate([*terms, np.zeros(1, np.int32)])
        starts = np.cumsum([0, *map(len, terms)])[:-1]
        empty = np.array([len(t) == 0 for t in terms])
        v = self.factors[at]
        sums = np.add.reduceat(v, starts)
        squares = np.add.reduceat((v * v).sum(1), starts)
        linear = np.add.reduceat(self.weights[at], starts)
        if len(terms) and len(terms[-1]):  # the last segment also took the closing place
            sums[-1] -= v[-1]
            squares[-1] -= (v[-1] * v[-1]).sum()
            linear[-1] -= self.weights[at[-1]]
        sums[empty], squares[empty], linear[empty] = 0, 0, 0
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, at, starts


def distinct(terms: list[np.ndarray]) -> np.ndarray:
    """The first of each group of texts with the same eight least places after scrambling: copies and most near copies of a text count once."""
    keys = [tuple(np.sort((t.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15))[:8].tolist()) for t in terms]
    return np.array(sorted({key: i for i, key in reversed([*enumerate(keys)])}.values()), dtype=np.int64)


def informative(terms: list[np.ndarray], labels: np.ndarray, least: int, bounds: tuple[tuple[float, float], ...]) -> np.ndarray:
    """The places in at least `least` texts whose log odds ratio with the label is, for one of the bounds (effect, errors), larger in size than the
    effect by so many standard errors: strong effects may be rarer, weak ones must be sure."""
    with_1, with_any = np.zeros(1 << BITS), np.zeros(1 << BITS, np.int64)
    for t, label in zip(terms, labels, strict=True):  # text by text: the terms of all texts side by side are most of the driver's memory
        with_1[t] += label
        with_any[t] += 1
    ones = labels.sum()
    table = [with_1 + 0.5, ones - with_1 + 0.5, with_any - with_1 + 0.5, len(labels) - ones - with_any + with_1 + 0.5]
    odds = np.log(table[0] / table[1]) - np.log(table[2] / table[3])
    error = np.sqrt(sum(1 / x for x in table))
    return np.flatnonzero((with_any >= least) & np.any([np.abs(odds) - e * error >= effect for effect, e in bounds], axis=0))


def joint(terms: list[np.ndarray], labels: np.ndarray, least: int, share: float = 0.02, effect: float = 1.0, errors: float = 6.0, chunk: int = 512) -> np.ndarray:
    """The places of terms that say something in a pair though they may be neutral alone: those of pairs in at least `least` texts whose log odds ratio
    with the label is off what both terms have alone by the effect and so many standard errors. All places in at least `least`
    texts and this share of all texts are paired, chunk by chunk: as a text has so many terms on average, their number is that over the share at most."""
    texts_with = np.zeros(1 << BITS, np.int64)
    for t in terms:
        texts_with[t] += 1
    frequent = np.flatnonzero(texts_with >= max(least, share * len(terms)))
    to = np.full(1 << BITS, -1, np.int32)
    to[frequent] = np.arange(len(frequent), dtype=np.int32)
    toxic = labels > 0
    # each place's texts in order, dealt to where they belong at once
    own = np.repeat(np.arange(len(frequent), dtype=np.int32), texts_with[frequent])
    text, at = np.zeros(len(own), np.int32), np.cumsum(texts_with[frequent]) - texts_with[frequent]
    counts = [np.zeros(len(frequent), np.int64) for _ in (0, 1)]
    for i, t in enumerate(terms):
        here = to[t]
        here = here[here >= 0]
        text[at[here]] = i
        at[here] += 1
        counts[int(toxic[i])][here] += 1
    rank = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) - 1  # a text's place among those of its label
    totals = np.array([len(labels) - toxic.sum(), toxic.sum()], np.float64)
    alone = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))

    def block(lo: int) -> list[np.ndarray]:
        """For each label texts x places of a chunk: which text has which."""
        x, y = np.searchsorted(own, [lo, lo + chunk])
        out = [np.zeros((int(n), min(chunk, len(frequent) - lo)), np.float32) for n in totals]
        for k in (0, 1):
            at = np.flatnonzero(toxic[text[x:y]] == bool(k)) + x
            out[k][rank[text[at]], own[at] - lo] = 1
        return out

    clear = np.zeros(len(frequent), bool)
    for lo in range(0, len(frequent), chunk):
        left = block(lo)
        for to_ in range(lo, len(frequent), chunk):
            right = None  # gone before the next one is made
            right = left if to_ == lo else block(to_)
            both = [x.T @ y for x, y in zip(left, right, strict=True)]
            off = np.log((both[1] + 0.5) / (totals[1] + 1)) - np.log((both[0] + 0.5) / (totals[0] + 1)) - alone[lo : lo + chunk, None] - alone[None, to_ : to_ + chunk]
            error = np.sqrt(1 / (both[0] + 0.5) + 1 / (both[1] + 0.5))
            found = (both[0] + both[1] >= least) & (np.abs(off) >= effect + errors * error)
            if to_ == lo:
                np.fill_diagonal(found, False)
            clear[lo : lo + chunk] |= found.any(1)
            clear[to_ : to_ + chunk] |= found.any(0)
    return frequent[clear]


def fit(
    terms: list[np.ndarray], labels: np.ndarray, dimensions: int = 8, steps: int = 1500, batch: int = 128, rate: float = 0.3, l1: float = 0.2, l2: float = 1e-3, least: int = 4, bounds: tuple[tuple[float, float], ...] = ((1.0, 2.5), (0.3, 4.0)), seed: int = 5
) -> FactorizationMachine:
    """Fit by follow-the-regularised-leader on the weights, whose L1 leaves terms without bearing at 0, and AdaGrad on the factors.
    Only terms that are informative alone or in a pair take part, so that a long text's many indifferent words don't add up. Without labels of both kinds every score is
    the share of label 1 (0 if none)."""
    rng, places = np.random.default_rng(seed), 1 << BITS
    labels = np.asarray(labels, float)
    out = FactorizationMachine(0.0, np.zeros(places, np.float32), np.zeros((places, dimensions), np.float32))
    share = labels.mean() if len(labels) else 0.0
    out.bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    if share in (0.0, 1.0):
        return out
    once = distinct(terms)
    terms, labels = [terms[i] for i in once], labels[once]
    kept = np.union1d(informative(terms, labels, least, bounds), joint(terms, labels, 5 * least))
    if not len(kept):
        return out
    to = np.full(places, -1, np.int64)
    to[kept] = np.arange(len(kept))
    terms = [x[x >= 0] for x in (to[t] for t in terms)]
    small = FactorizationMachine(out.bias, np.zeros(len(kept)), rng.normal(0, 0.1, (len(kept), dimensions)))
    z, n, squared = np.zeros(len(kept)), np.zeros(len(kept)), np.full((len(kept), dimensions), 1e-8)
    bias_n = 1.0
    for _ in range(-(-steps * batch // len(terms))):
        order = rng.permutation(len(terms))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            held = [terms[i] for i in pick]
            logit, sums, at, _ = small.logits(held)
            p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            g = p - labels[pick]
            sizes = np.array([len(t) for t in held])
            at, g_at = at[:-1], np.repeat(g, sizes)
            here, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, g_at, minlength=len(here))
            sigma = (np.sqrt(n[here] + gw * gw) - np.sqrt(n[here])) / rate
            z[here] += gw - sigma * small.weights[here]
            n[here] += gw * gw
            zh = z[here]
            small.weights[here] = np.where(np.abs(zh) <= l1, 0.0, -(zh - np.sign(zh) * l1) / ((1.0 + np.sqrt(n[here])) / rate + l2))
            grad = g_at[:, None] * (np.repeat(sums, sizes, axis=0) - small.factors[at])
            total = np.stack([np.bincount(inverse, grad[:, d], minlength=len(here)) for d in range(dimensions)], 1) + l2 * small.factors[here]
            squared[here] += total * total
            small.factors[here] -= rate / 3 * total / np.sqrt(squared[here])
            small.bias -= rate * g.sum() / np.sqrt(bias_n)
            bias_n += g.sum() ** 2
    out.bias, out.weights[kept], out.factors[kept] = float(small.bias), small.weights, small.factors
    return out


def _forget() -> None:
    _known.clear()


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **options) -> FactorizationMachine:
    """A model of labels.toxic from at most max_rows labelled documents outside the held-out fifth, taken in the order of a hash of doc_id.

    Rows with a null id or label are left out, and the text of a document is never cut. Terms are found on the executors; the driver gets only their
    places for the bounded sample and fits there.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of(t).tolist() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    rows = joined.mapInArrow(lean(run, _forget), "doc_id long, toxic int, terms array<int>").orderBy(F.xxhash64("doc_id", "terms"), "doc_id").limit(max_rows).toArrow()
    terms = rows.column("terms").combine_chunks()
    toxic = rows.column("toxic").to_numpy()
    del rows  # its chunks hold all terms once more
    flat, ends = terms.flatten().to_numpy(), np.cumsum(np.r_[0, terms.value_lengths().to_numpy()])
    model = fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], toxic, **options)
    del terms, flat
    give_back()  # the driver lives on through all stages of a pipeline
    return model


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The columns of docs with score (0 to 1) and predicted (1 from 0.5) for every row, null and empty texts included, which get the score of no terms.

    Columns of docs named score or predicted are replaced; a repeated row is scored like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("score", "predicted")])
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS places: of a fixed size
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                p = fm.scores([terms_of(t) for t in b.column(at).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=names)

    names = [*docs.columns, "score", "predicted"]
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(lean(run, _forget), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    # only the text is an input of the score: doc_id is carried along
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


ORACLE_SQL = None  # a trained model: tests/llm measures held-out accuracy
