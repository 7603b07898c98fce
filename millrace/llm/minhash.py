"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set: its shingles of five words, each weighing as often as it occurs. Darts are thrown at the plane of (shingle, weight) by
hashing, as a Poisson process in time; a dart counts for a document if it lands in the region its weights cover. For each of the signature's
coordinates the earliest dart is kept, so two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Only the few
darts that land early enough are ever enumerated, however large the document, and most shingles are done after one hash.

Banded signatures give candidate pairs, and those are verified exactly. Candidates of a band are not all pairs: each document of a bucket is first held
against one of them only. Where that leaves several components in a bucket, its documents are dealt into blocks, and a task holds two rows of blocks,
compares all pairs of blocks that are not connected yet, and hands on only as many links as connect what they connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard, lean, read_table, words_in
from millrace.llm.graph import connected_components

NAME = "op6_minhash_near_dedup"
_CACHE_WORDS = 150_000
_COLUMNS = 8192
_hashes: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_hashes) > _CACHE_WORDS:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes | None, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, as sorted 64-bit hashes, and how often each occurs.

    Words are what white space separates, A-Z in lower case. A text of fewer words is one shingle, one of no words has none."""
    h = word_hashes((text or b"").lower().split())
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = max(1, len(h) - words + 1)
    key = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(key, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """sets x k 64-bit values: for each set and coordinate which dart comes first in the region under the set's weights. No set may be empty.

    The unit cells of a shingle's weight are thrown at apart, in time at rate 1 for each coordinate's share of a cell: the cell's n-th dart comes an
    exponential delay after the one before, hits a random height of the cell and belongs to a random coordinate. Only darts up to a horizon are
    enumerated, about k log k for each set; where a coordinate is left without one the horizon doubles."""
    weights = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])
    count = np.ceil(weights).astype(np.int64)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner, height = np.repeat(owner, count), np.minimum(1.0, np.repeat(weights, count) - number)
    cells = _mix(np.repeat(np.concatenate([x for x, _ in sets]), count) + _mix(number.astype(np.uint64) + np.uint64(1)))
    horizon = (np.log(k) + 2) / np.bincount(owner, height, minlength=len(sets))
    out, todo = np.zeros((len(sets), k), np.uint64), np.arange(len(sets))
    while len(todo):
        best, value = np.full(len(sets) * k, np.inf), np.zeros(len(sets) * k, np.uint64)
        state, doc, time, top = cells, owner, np.zeros(len(cells)), height
        while len(state):
            state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
            u = ((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
            # -log(u) / k is the delay: most cells have none within the horizon, which a comparison tells without a logarithm
            within = np.flatnonzero(u >= (np.exp(k * (time - horizon[doc])) if time.any() else np.exp(-k * horizon)[doc]))
            state, doc, top, time = state[within], doc[within], top[within], time[within] - np.log(u[within]) / k
            spot = _mix(state ^ np.uint64(0xD1B54A32D192ED03))
            hit = ((spot >> np.uint64(11)).astype(np.float64) * 2.0**-53) < top
            slot, when, dart = doc[hit] * k + (_mix(spot[hit]) % np.uint64(k)).astype(np.int64), time[hit], state[hit]
            order = np.argsort(-when, kind="stable")  # of darts at one place the earliest is written last
            order = order[when[order] < best[slot[order]]]
            best[slot[order]], value[slot[order]] = when[order], dart[order]
        full = np.isfinite(best.reshape(-1, k)[todo]).all(1)
        out[todo[full]] = value.reshape(-1, k)[todo[full]]
        todo = todo[~full]
        again = np.isin(owner, todo)
        cells, owner, height = cells[again], owner[again], height[again]
        horizon[todo] *= 2
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common) / max(float(a[1].sum() + b[1].sum() - common), 1e-300)


def _forget() -> None:
    _hashes.clear()


def _bands(texts: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """(id, keys array<long>): a hash of each band of the signature of each text that has a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                b = whole.slice(lo, 128)
                sets = [shingles(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
                held = [i for i, (x, _) in enumerate(sets) if len(x)]
                ids = [x for i, x in enumerate(b.column(0).to_pylist()) if len(sets[i][0])]
                keys = []
                if held:
                    sig = signatures([sets[i] for i in held], bands * rows).reshape(-1, bands, rows)
                    key = np.tile(np.arange(bands, dtype=np.uint64), (len(held), 1))
                    for r in range(rows):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                    keys = key.view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "keys"])

    return texts.mapInArrow(lean(run, _forget), "id string, keys array<long>")


def _verified(pieces: DataFrame, threshold: float, words: int) -> DataFrame:
    """(a, b): those of the pieces (id, text, to) whose texts are at least threshold similar to that of `to`, which is a piece with itself."""
    left = pieces.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"), F.col("text").alias("ta"))
    right = pieces.where("id = to").select(F.col("to").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*[batch.column(i).cast(pa.binary()).to_pylist() if i > 1 else batch.column(i).to_pylist() for i in range(4)], strict=True):
                if last[0] != b:  # neighbouring rows share b
                    last = (b, shingles(tb, words))
                keep.append(similarity(shingles(ta, words), last[1]) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, "b").select("a", "b", "ta", "tb").mapInArrow(lean(run, _forget), "a string, b string")


def _cells(text: bytes | None, words: int) -> np.ndarray:
    """A text's shingles as 64-bit numbers, a shingle that occurs again under another number each time, so that two texts share as many cells as the
    weight that their weighted sets share."""
    keys, weights = shingles(text, words)
    number = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    keys = np.repeat(keys, weights)
    return np.where(number > 0, _mix(keys + _mix(number.astype(np.uint64))), keys)


def _ties(rows: list[dict], others: list[dict], threshold: float) -> list[tuple[str, str]]:
    """Links between texts of different components, as few as connect the same components: all pairs among rows, or of rows with others."""
    whole = rows + others
    cells = [r["cells"] for r in whole]
    sizes = np.array([len(c) for c in cells], np.float64)
    flat, owner = np.concatenate(cells), np.repeat(np.arange(len(cells)), sizes.astype(np.int64))
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    # only cells of several texts can be shared; the others have no column
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    owner, column = owner[order], column[order]
    left, right = (len(rows), len(whole)) if others else (len(whole), len(whole))
    first = left if others else 0
    shared = np.zeros((left, right - first), np.float32)
    for lo in range(0, int(count[count > 1].size), _COLUMNS):
        x, y = np.searchsorted(column, [lo, lo + _COLUMNS])
        part = np.zeros((len(whole), _COLUMNS), np.float32)
        part[owner[x:y], column[x:y] - lo] = 1
        shared += part[:left] @ part[first:].T
    linked = shared / (sizes[:left, None] + sizes[None, first:] - shared) >= threshold
    names, component = np.unique([r["component"] for r in whole], return_inverse=True)
    linked &= component[:left, None] != component[None, first:]
    up = list(range(len(names)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    out = []
    r, c = np.nonzero(linked)
    for i, j in np.unique(np.stack([component[r], component[first + c]], 1), axis=0).tolist() if len(r) else []:
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((str(names[i]), str(names[j])))
    return out


def _grid(blocks: dict[int, list[dict]], side: int, threshold: float) -> list[tuple[str, str]]:
    """Links as _ties gives them between the texts of blocks, all of one or two rows of `side` blocks: of one row all pairs of blocks, of two rows those
    that are across. Blocks whose texts are connected by then are not compared."""
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while up.get(c, c) != c:
            up[c] = c = up.get(up[c], up[c])
        return c

    out, order = [], sorted(blocks)
    across = order[0] // side != order[-1] // side
    for k, i in enumerate(order):
        for j in order[k:]:
            if across and i // side == j // side:
                continue
            rows, others = ([r | {"component": top(r["component"])} for r in blocks[b]] for b in (i, j))
            if len({r["component"] for r in rows + others}) > 1:
                for a, b in _ties(rows, others if i != j else [], threshold):
                    up[max(top(a), top(b))] = min(top(a), top(b))
                    out.append((a, b))
    return out


def _between(placed: DataFrame, texts: DataFrame, threshold: float, words: int, block: int = 256, block_words: int = 1 << 18, side: int = 8) -> DataFrame:
    """(a, b): components of placed (id, key, component) that a link joins which lies inside a bucket, as few rows as connect the same components.

    The texts of a bucket are dealt into blocks of about `block` texts and `block_words` words, and blocks stand in rows of `side`. A task holds two rows of
    blocks at most and compares all pairs of blocks in them, so that a text is handed on once for each row of its bucket and not for each block; what a task
    hands on is at most a row for each text it has."""
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("docs"), F.bit_xor(F.xxhash64("id")).alias("marks"))
    split = counted.groupBy("key").agg(F.count("*").alias("components"), F.sum("docs").alias("docs"), F.bit_xor("marks").alias("marks")).where("components > 1")
    once = cut(split.groupBy("docs", "marks").agg(F.min("key").alias("key")).select("key"))  # buckets that hold the same texts count once
    left = cut(placed.join(once, "key").select("id", "key", "component"))
    held = cut(texts.join(left.select("id").distinct(), "id", "left_semi").select("id", "text", words_in(F.col("text")).alias("n")))
    sizes = left.join(held.select("id", "n"), "id").groupBy("key").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    sizes = cut(sizes.select("key", F.ceil(F.greatest(F.col("docs") / block, F.col("n") / block_words)).cast("int").alias("blocks")))
    at = F.pmod(F.xxhash64("key", "id"), "blocks").cast("int")
    numbered = left.join(sizes, "key").select("id", "key", "component", at.alias("at"), F.ceil(F.col("blocks") / side).cast("int").alias("rows"))
    own = F.floor(F.col("at") / side).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    tasks = numbered.select("id", "key", "component", "at", "rows", F.inline(both)).join(held.select("id", "text"), "id")

    def links(rows: list[dict]) -> list[tuple[str, str]]:
        blocks: dict[int, list[dict]] = {}
        for r in rows:
            blocks.setdefault(r["at"], []).append({"component": r["component"], "cells": _cells(r["text"].encode("utf-8", "surrogatepass"), words)})
        return _grid(blocks, side, threshold)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                if found := links(batch.column(0)[r].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*found, strict=True)], names=["a", "b"])

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := links([r for b in batches for r in b.select(["at", "component", "text"]).to_pylist()]):
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*found, strict=True)], names=["a", "b"])

    # most buckets are one block of a few texts, which come as lists; those of many blocks come as streams, so that no list of them is built in the JVM
    single = sizes.where("blocks = 1").select("key")
    lists = tasks.join(single, "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("at", "component", "text")).alias("members")).select("members")
    grids = tasks.join(single, "key", "left_anti").groupBy("key", "i", "j").applyInArrow(large, "a string, b string")
    return lists.mapInArrow(lean(small, _forget), "a string, b string").unionByName(grids)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 16, rows: int = 4, words: int = 5) -> DataFrame:
    """The columns of docs, then group_id and keep, for every row of docs (doc_id, text).

    Documents whose weighted sets of shingles are at least `threshold` similar are linked; group_id is the least doc_id of all
    rows that links connect, and keep marks one row that bears it (null ids come last). Rows of equal text are in one group. Null texts and texts
    without words are in no group: group_id is their own doc_id and they are kept. With 16 bands of 4 coordinates a pair at 0.8 shares a band in all but 0.03 % of cases, one at 0.9 in all but
    0.00002 %; no bucket is capped. Columns of docs named group_id or keep are replaced; an empty table gives no rows.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("group_id", "keep")])
    # texts that are equal byte for byte are compared once, under a hash of 128 bits
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    id_ = F.md5(F.col("text").cast("string").cast("binary"))
    texts = docs.where(some).select(id_.alias("id"), F.col("text").cast("string").alias("text"))
    banded = cut(_bands(texts, bands, rows, words).dropDuplicates(["id"]))
    buckets = banded.select("id", F.explode("keys").alias("key"))  # a key tells its band, too
    shared = cut(buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size"))
    inside = cut(buckets.join(shared, "key").select("id", "key", "size"))
    discard(banded, shared)
    # the text of a bucket that shares most buckets with most others: what its copies were made from, if it is there
    central = cut(inside.groupBy("id").agg(F.sum("size").alias("weight")))
    weighed = cut(inside.join(central, "id").select("key", "id", "weight"))
    pivots = cut(weighed.groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("first")))
    discard(central, weighed)

    # each document of a bucket against one of them: a text is handed to the few it is held against, and to itself if others are held against it
    tried = inside.join(pivots, "key").select("id", F.col("first").alias("to")).distinct()
    asked = cut(tried.groupBy("id").agg(F.collect_list("to").alias("to")))  # no more than there are bands
    pieces = cut(texts.dropDuplicates(["id"]).join(asked, "id").select("id", "text", F.posexplode("to").alias("n", "to")))
    discard(pivots, asked)
    edges = cut(_verified(pieces, threshold, words))
    components = cut(connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))))

    # components that still share a bucket
    placed = cut(inside.join(components.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("component", "id").alias("component")))
    ties = cut(_between(placed, pieces.where("n = 0").select("id", "text"), threshold, words))
    discard(inside, pieces, placed, edges)
    merged = connected_components(ties.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    final = components.join(merged.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    # a component of one text, which no edge names, may have been tied to others
    alone = merged.join(components, "node", "left_anti").select("node", "component")
    groups = cut(final.unionByName(alone).select(F.col("node").alias("__id"), F.col("component").alias("__c")))

    # one row of each group is kept; the row of a text that is kept is told by its number among equal ones
    held = docs.where(some).select("doc_id", id_.alias("__id")).groupBy("doc_id", "__id").count()
    members = held.join(groups, "__id", "left").select("doc_id", "__id", F.coalesce("__c", "__id").alias("__group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("__id").alias("id")))
    least = cut(members.groupBy("__group").agg(first.alias("__least")))
    of = cut(groups.join(least, F.col("__c") == F.col("__group")).select("__id", "__least"))  # of texts in groups; any other text's group is its own
    own = cut(least.join(groups.select(F.col("__id").alias("__group")), "__group", "left_anti").select(F.col("__group").alias("__id"), "__least"))
    # rows with the chosen text and id may repeat: one of them stays, by a hash of the columns that can be hashed
    hashable = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    named = docs.where(some).select("*", id_.alias("__id"), F.xxhash64(*hashable).alias("__tie"))
    out = named.join(of.unionByName(own), "__id").withColumn("__chosen", F.col("doc_id").eqNullSafe(F.col("__least.doc_id")) & (F.col("__id") == F.col("__least.id")))
    group_id = F.col("__least.doc_id").alias("group_id")
    carried = [F.col(c) for c in docs.columns]
    rest = out.where("NOT __chosen").select(*carried, group_id, F.lit(False).alias("keep"))
    chosen = out.where("__chosen").withColumn("__copy", F.row_number().over(W.partitionBy("__id", "doc_id").orderBy("__tie"))).select(*carried, group_id, (F.col("__copy") == 1).alias("keep"))
    blank = docs.where(~some).select(*carried, F.col("doc_id").alias("group_id"), F.lit(True).alias("keep"))
    return rest.unionByName(chosen).unionByName(blank)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "group_id", "keep")


ORACLE_SQL = None  # tests/llm holds it against all pairs of a small table
