"""Removing repeated byte strings, with suffix arrays by induced sorting over shards.

A string of `length` bytes that occurs twice has the same `anchor` both times: the least, by a hash, of the 32-byte strings inside it. Each run of
string starts with one anchor is a segment, and everything a string can equal lies in segments of the same anchor. So

* segments whose anchor occurs once hold nothing repeated and are dropped at once; most of a corpus goes here,
* segments that are equal as a whole are repeated as a whole, which counting them tells,
* where one anchor has different segments, these are halved: strings with more of themselves to the anchor's left, and the others. Halves that
  differ in what all their strings hold can't match, equal ones are repeated as a whole, and one of each of the others goes to a shard with those it may match. A shard
  concatenates its pieces, builds their suffix array by induced sorting and the permuted common prefixes, and neighbours that share `length`
  bytes or more are repeats.

Very many different pieces that may match would make too large a shard. Such pieces are halved again, under keys that fewer of them share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import cut, discard, lean, parts, read_table
from millrace.llm.suffix import repeated

NAME = "op2_suffix_array_dedup"
LENGTH, GRAM = 200, 32
_PLACE = 24  # bits of a position inside a batch; the other 40 order the anchors
_BATCH = 1 << 19
_tables: dict = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a buffer in constant time: sums of a random number for each byte times powers of an odd number, modulo 2^64."""

    def __init__(self, buffer: np.ndarray, kind: int):
        n = len(buffer) + 1
        if len(_tables.get(kind, [[]])[0]) < n:
            rng = np.random.default_rng(1000 + kind)
            base = int(rng.integers(1 << 62)) * 2 + 1
            powers = [np.cumprod(np.full(max(n, 2 * _BATCH), b, np.uint64)) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))]
            _tables[kind] = (*powers, rng.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        up, self.down, values = _tables[kind]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values[buffer] * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def segments(texts: list[bytes], length: int = LENGTH):
    """(text, anchor, content, start, count) of each segment of some texts: its text's number, hashes of its anchor and of its whole content, its place in the
    text and how many strings of `length` bytes start in it. Texts shorter than that have none."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(np.r_[0, sizes])[:-1]
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buffer)
    if n < length:
        return [np.zeros(0, np.int64)] * 5
    if n > 1 << _PLACE:
        raise ValueError(f"{n} bytes at once are more than {_PLACE} bits of a position can tell apart")
    one = Rolling(buffer, 1)
    grams = n - GRAM + 1
    at = np.arange(grams)
    h = one.of(at, at + GRAM)
    low = (h & np.uint64((1 << 64) - (1 << _PLACE))) | at.astype(np.uint64)
    span = 1
    wide = length - GRAM + 1  # 32-byte strings in one of `length`
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: n - length + 1], low[wide - span : wide - span + n - length + 1])
    anchor = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: n - length + 1]
    inside = np.arange(n - length + 1) + length <= (begin + sizes)[owner]  # strings that end in the text they start in
    breaks = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])])
    count = np.diff(np.r_[breaks, n - length + 1])
    keep = inside[breaks]
    breaks, count = breaks[keep], count[keep]
    end = breaks + count - 1 + length
    a = anchor[breaks]
    shape = _mix((count.astype(np.uint64) << np.uint64(32)) + (a - breaks).astype(np.uint64) + np.uint64(1))
    content = Rolling(buffer, 2).of(breaks, end) ^ shape
    t = owner[breaks]
    return [t, h[a].view(np.int64), content.view(np.int64), breaks - begin[t], count]


def _batched(texts: list[bytes], length: int, limit: int = _BATCH) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(numbers of texts, places in them, stretches) of runs of about limit bytes, twice that at most. A longer text comes in stretches that overlap by
    length - 1 bytes, so each string of `length` bytes is whole in one stretch and starts in no other."""
    which, places, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), limit):
            which.append(i)
            places.append(at)
            held.append(t[at : at + limit + length - 1])
            size += len(held[-1])
            if size >= limit:
                yield which, places, held
                which, places, held, size = [], [], [], 0
    if held:
        yield which, places, held


def _rows(docs: DataFrame, length: int) -> DataFrame:
    """A row for each segment of each document, by (doc_id, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for numbers, places, part in _batched(texts, length):
                t, a, c, s, n = segments(part, length)
                which = pa.array(np.array(numbers)[t])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(a), pa.array(c), pa.array(np.array(places)[t] + s, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "h", "anchor", "content", "start", "n"])

    return docs.mapInArrow(lean(run), "doc_id long, h long, anchor long, content long, start int, n int")


def _pieces(data: bytes, p: int, lo: int, hi: int, length: int) -> list[tuple[int, int, bytes, int, bytes]]:
    """The two halves of a piece: (lo, hi, what all their strings hold, offset in the piece, the bytes they cover).

    p is the anchor's place in the piece. A string is told by how far it reaches to the anchor's left; those of a piece reach from lo to under hi."""
    n, out = len(data) - length + 1, []
    middle = (lo + hi + 1) // 2
    for least, most in ((middle, hi), (lo, middle)):
        first, last = max(0, p - most + 1), min(n - 1, p - least)  # strings by where they start
        if first <= last and least < most:
            held = data[max(0, p - least) : p + length - most + 1]
            out.append((least, most, held, first, data[first : last + length]))
    return out


_HALVES = "anchor long, lo int, hi int, k1 long, k2 long, doc_id long, h long, start int, p int, single boolean, data binary, c1 long, c2 long"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())


def _halve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces (anchor, lo, hi, doc_id, h, start, p, single, data) -> their halves, under a hash of what all strings of the half hold; p under 0 is yet to be found."""
    for batch in (w.slice(lo, 512) for w in batches for lo in range(0, w.num_rows, 512)):
        rows = []
        for anchor, lo, hi, doc_id, h, start, p, single, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if p < 0:
                at = np.arange(len(data) - GRAM + 1)
                p = int(np.flatnonzero(Rolling(np.frombuffer(data, np.uint8), 1).of(at, at + GRAM).view(np.int64) == anchor)[0])
            for least, most, key, offset, piece in _pieces(data, p, lo, hi, length):
                rows.append((anchor, least, most, *_digest(key), doc_id, h, start + offset, p - offset, single, piece, *_digest(piece)))
        cols = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=[f.split()[0] for f in _HALVES.split(", ")])


def _digest(data: bytes) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _search(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Different pieces, those that can match side by side -> where repeats are in those that occur once, as (doc_id, h, start, end).

    Groups are gathered to shards of about shard_bytes; a group is never cut. What all strings of a group hold stands as one symbol in its pieces."""

    def search(shard: list[tuple]) -> pa.RecordBatch:
        doc, hs, starts, ends = [], [], [], []
        for (doc_id, h, start, single, _, _, _), positions in zip(shard, repeated([r[4] for r in shard], length, [r[5:] for r in shard]), strict=True):
            if single and len(positions):
                edges = np.flatnonzero(np.diff(positions) > 1)
                first, last = positions[np.r_[0, edges + 1]] + start, positions[np.r_[edges, len(positions) - 1]] + start + length
                doc += [doc_id] * len(first)
                hs += [h] * len(first)
                starts += first.tolist()
                ends += last.tolist()
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(hs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "h", "start", "end"])

    shard, held, last, group = [], 0, None, 0
    for batch in batches:
        for anchor, lo, hi, k1, k2, doc_id, h, start, p, single, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (anchor, lo, hi, k1, k2) != last:
                if held >= shard_bytes:
                    yield search(shard)
                    shard, held = [], 0
                last, group = (anchor, lo, hi, k1, k2), group + 1
            # strings of the piece reach from lo to under hi to the anchor's left, so all of them hold this
            shard.append((doc_id, h, start, single, data, (p - lo, p + length - hi + 1), group))
            held += len(data)
    if shard:
        yield search(shard)


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = 1 << 18, most: int = 2000) -> DataFrame:
    """(doc_id, h, spans) of documents (doc_id, h, text) that hold repeats: spans are unmerged (start, end) of bytes that a repeated string covers.

    most: pieces of a key that has more different ones are halved again, which gives keys that fewer of them share, down to single strings."""
    rows = cut(_rows(docs, length))
    # what is joined with a table by a key that many rows may share is written first, so that Spark can split the crowded side
    twice = cut(rows.groupBy("anchor").count().where("count > 1").select("anchor"))
    shared = cut(rows.join(twice, "anchor", "left_semi"))
    discard(rows, twice)
    rows = shared
    kinds = cut(rows.groupBy("anchor", "content").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "h", "start", "n")).alias("rep")))
    same = cut(kinds.where("k > 1").select("anchor", "content"))
    whole = cut(rows.join(same, ["anchor", "content"], "left_semi").select("doc_id", "h", "start", (F.col("start") + F.col("n") - 1 + length).alias("end")))
    discard(rows, same)

    several = cut(kinds.groupBy("anchor").agg(F.count("*").alias("variants"), F.min("k").alias("least")).where("variants > 1 AND least = 1").select("anchor"))
    open_ = kinds.join(several, "anchor").select(
        F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h"), F.struct("anchor", F.col("rep.start").alias("start"), F.col("rep.n").alias("n"), (F.col("k") == 1).alias("single")).alias("want")
    )
    wants = open_.groupBy("doc_id", "h").agg(F.collect_list("want").alias("wants"))  # at most a document's own segments
    found = docs.alias("d").join(wants.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.h") == F.col("w.h")))
    taken = found.select("d.doc_id", "d.h", F.col("d.text").cast("binary").alias("bytes"), F.explode("w.wants").alias("want")).select(
        F.col("want.anchor").alias("anchor"), F.lit(0).alias("lo"), F.lit(length - GRAM + 1).alias("hi"), "doc_id", "h", F.col("want.start").alias("start"), F.lit(-1).alias("p"), F.col("want.single").alias("single"), F.expr(f"substring(bytes, want.start + 1, want.n + {length - 1})").alias("data")
    )
    # halves: again equal ones are repeated as a whole, and only where one key has different ones is anything left to search
    key, content, spots = ["anchor", "lo", "hi", "k1", "k2"], ["c1", "c2"], F.struct("doc_id", "h", "start")
    equal, searched = [], []
    while taken is not None:
        halves = cut(taken.mapInArrow(lean(lambda b: _halve(b, length)), _HALVES))
        counted = [F.countDistinct(spots).alias("k"), F.min(spots).alias("rep"), F.max("single").alias("single"), F.first("data").alias("data"), F.first("p").alias("p"), (~F.min("single")).alias("many")]
        pieces = cut(halves.groupBy(*key, *content).agg(*counted))
        twice = cut(pieces.where("(k > 1 OR many) AND single").select(*key, *content))
        equal.append(cut(halves.where("single").join(twice, [*key, *content], "left_semi").select("doc_id", "h", "start", (F.col("start") + F.octet_length("data")).alias("end"))))
        discard(halves, twice)
        lone = (F.col("k") == 1) & F.col("single") & ~F.col("many")
        open_keys = cut(pieces.groupBy(*key).agg(F.count("*").alias("variants"), F.max(lone).alias("lone")).where("variants > 1 AND lone AND hi - lo > 1").select(*key, (F.col("variants") > most).alias("crowded")))
        left = cut(pieces.join(open_keys, key).select(*key, F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h"), F.col("rep.start").alias("start"), "p", lone.alias("single"), "data", "crowded"))
        discard(pieces)
        discard(open_keys)
        searched.append(left.where("NOT crowded"))
        again = left.where("crowded")
        taken = None if again.isEmpty() else again.select("anchor", "lo", "hi", "doc_id", "h", "start", "p", "single", "data")
    left = searched[0]
    for more in searched[1:]:
        left = left.unionByName(more)
    dealt = left.select(*key, "doc_id", "h", "start", "p", "single", "data").repartition(parts(docs.sparkSession), "anchor", "k1", "k2").sortWithinPartitions(*key, "doc_id", "h", "start")
    spans = dealt.mapInArrow(lean(lambda b: _search(b, length, shard_bytes)), "doc_id long, h long, start int, end int").unionByName(whole)
    for more in equal:
        spans = spans.unionByName(more)
    return spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """The columns of docs, then removed (array of (start, end) byte ranges, merged, in order) and kept (binary), for every row of docs (doc_id, text).

    Texts are taken as UTF-8 bytes; every byte covered by a string of `length` bytes that also starts anywhere else, in the same text or another, is
    removed, judged on the input. Copies of a text therefore all lose all of it if it has `length` bytes or more. Null and empty texts and ones that are shorter lose
    nothing (kept is empty for null). Rows may repeat and ids may be null. Columns of docs named removed or kept are replaced; an empty table gives no rows.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("removed", "kept")])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(keyed.where(F.octet_length("text") >= length), length, **options).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("spans").alias("__spans"))
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__h")), "left").drop("__d", "__h")
    names = docs.columns
    joined = joined.select(*names, F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("__bytes"), F.coalesce(F.transform("__spans", lambda s: s["start"]), F.array().cast("array<int>")).alias("__from"), F.coalesce(F.transform("__spans", lambda s: s["end"]), F.array().cast("array<int>")).alias("__to"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                at = len(names)
                removed, kept = [], []
                for data, starts, ends in zip(b.column(at).to_pylist(), b.column(at + 1), b.column(at + 2), strict=True):
                    s, e = np.asarray(starts.values, np.int64), np.asarray(ends.values, np.int64)
                    if len(s):
                        by = np.argsort(s, kind="stable")
                        s, e = s[by], np.maximum.accumulate(e[by])
                        first = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                        s, e = s[first], e[np.r_[first[1:] - 1, len(e) - 1]]
                        kept.append(b"".join(data[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True)))
                    else:
                        kept.append(data)
                    removed.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], names=[*names, "removed", "kept"])

    return joined.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")]))), T.StructField("kept", T.BinaryType())]))


def whole_characters(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    """What is left of a UTF-8 text without the removed (start, end), which are in order, and without the rest of any character they cut."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out, x = [], 0
    for start, end in [*removed, (len(text), len(text))]:
        y = start
        while y > max(x, start - 3) and inside(y):
            y -= 1
        out.append(text[x:y])
        x = end
        while x < min(len(text), end + 3) and inside(x):
            x += 1
    return b"".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = None  # every 200-byte string of every text is too much for SQL; tests/llm holds it against that count
