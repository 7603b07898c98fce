"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least t lie within epsilon = sqrt(2 - 2t). Along the leading principal directions (any orthonormal directions give a
valid bound; these tell most vectors apart) space is cut into cells of edge epsilon, and vectors are sorted by their cells. A stretch of the sorted
sequence is a block with a bounding box. Pairs of stretches are joined recursively: a pair whose boxes are more than epsilon apart in some direction
holds no link and is dropped with all pairs inside it, others are split further, first between groups of blocks, then between blocks, then between
tiles inside the task that has two blocks at hand. What is left is compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, read_table
from millrace.llm.graph import connected_components
from millrace.llm.vectors import matrix, usable

NAME = "op8_embedding_near_dedup"
_FAN = 16
_BLOCK_NUMBERS = 1 << 18


def principal_directions(vectors: DataFrame, width: int, dims: int, sample: int) -> np.ndarray:
    """width x dims: the leading principal directions of at most `sample` unit vectors, taken in the order of a hash. They only steer the pruning."""
    rows = vectors.where(F.size("embedding") == width).orderBy(F.xxhash64("embedding")).limit(sample).select("embedding").toArrow()
    x = matrix(rows.column(0).combine_chunks(), width) if rows.num_rows else np.eye(width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))
    return np.ascontiguousarray(axes[:, ::-1][:, :dims])


def _sequence(vectors: DataFrame, width: int, axes: np.ndarray, epsilon: float, block: int) -> DataFrame:
    """(rep, embedding, copies, along, at): the vectors, with their lengths along the directions and the number of their block. Blocks are stretches of `block`
    vectors in the order of the grid cells, wherever Spark cuts the sorted sequence into partitions."""
    dims = axes.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width)
            along = x / np.linalg.norm(x, axis=1, keepdims=True) @ axes
            lists = [pa.FixedSizeListArray.from_arrays(flat, dims).cast(pa.list_(flat.type)) for flat in (pa.array(along.ravel()), pa.array(np.floor(along / epsilon).astype(np.int32).ravel()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=["rep", "embedding", "copies", "along", "cell"])

    placed = vectors.mapInArrow(place, "rep long, embedding array<double>, copies long, along array<double>, cell array<int>")
    wanted = max(1, -(-vectors.count() // (4 * block)))
    ordered = cut(placed.repartitionByRange(wanted, "cell", "rep").sortWithinPartitions("cell", "rep").drop("cell").withColumn("place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # a row for each partition: how many vectors stand in those before
    sizes = ordered.groupBy(part.alias("part")).count()
    before = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    numbered = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    return numbered.select("rep", "embedding", "copies", "along", F.floor((F.col("before") + inside) / block).alias("at"))


def block_pairs(blocks: DataFrame, dims: int, epsilon: float) -> DataFrame:
    """(i, j) with i <= j for all pairs of blocks (at, and its box l0, h0, l1, ...) whose boxes are within epsilon, found from groups of groups of
    neighbouring blocks downwards."""
    lows, highs = [f"l{k}" for k in range(dims)], [f"h{k}" for k in range(dims)]
    level = cut(blocks.select(F.col("at").alias("id"), *lows, *highs, F.floor(F.col("at") / _FAN).alias("up")))
    levels, n = [level], level.count()
    while n > _FAN:
        level = cut(level.groupBy(F.col("up").alias("id")).agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]).withColumn("up", F.floor(F.col("id") / _FAN)))
        levels.append(level)
        n = level.count()
    pairs = None
    for level in reversed(levels):
        left, right = (level.select(*[F.col(c).alias(s + c) for c in level.columns]) for s in "ab")
        if pairs is None:
            pairs = left.withColumn("one", F.lit(1)).join(right.withColumn("one", F.lit(1)), "one")  # at most _FAN rows a side
        else:
            pairs = pairs.join(left, F.col("pa") == F.col("aup")).join(right, F.col("pb") == F.col("bup"))
        for k in range(dims):
            pairs = pairs.where((F.col(f"al{k}") - F.col(f"bh{k}") <= epsilon) & (F.col(f"bl{k}") - F.col(f"ah{k}") <= epsilon))
        pairs = cut(pairs.where("aid <= bid").select(F.col("aid").alias("pa"), F.col("bid").alias("pb")))
    return pairs.select(F.col("pa").alias("i"), F.col("pb").alias("j"))


def _compare(left: tuple, right: tuple | None, epsilon: float, threshold: float, tile: int, links: dict[int, int], ties: set[tuple[int, int]]) -> None:
    """Add what links two blocks (unit vectors, lengths along, nodes, copies), or one with itself: to links how many vectors a node links to, and to ties a
    node that links tie it to."""
    same = right is None
    (x, px, ix, cx), (y, py, iy, cy) = left, left if right is None else right
    for a in range(0, len(x), tile):
        alo, ahi = px[a : a + tile].min(0), px[a : a + tile].max(0)
        for b in range(a if same else 0, len(y), tile):
            if (np.maximum(alo - py[b : b + tile].max(0), py[b : b + tile].min(0) - ahi) > epsilon).any():
                continue
            hit = x[a : a + tile] @ y[b : b + tile].T >= threshold
            if same and a == b:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            r, c = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            hit = hit[np.ix_(r, c)]
            r, c = r + a, c + b
            for node, n in zip(ix[r].tolist(), (hit @ cy[c]).tolist(), strict=True):
                links[node] = links.get(node, 0) + n
            if not (same and a == b):
                for node, n in zip(iy[c].tolist(), (cx[r] @ hit).tolist(), strict=True):
                    links[node] = links.get(node, 0) + n
            # least node of each component of the tile's links, by passing least labels between rows and columns
            top = np.iinfo(np.int64).max
            rows, cols = ix[r].copy(), iy[c].copy()
            while True:
                new_rows = np.minimum(rows, np.where(hit, cols[None, :], top).min(1))
                new_cols = np.minimum(cols, np.where(hit, new_rows[:, None], top).min(0))
                if (new_rows == rows).all() and (new_cols == cols).all():
                    break
                rows, cols = new_rows, new_cols
            ties.update((u, v) for u, v in zip([*ix[r].tolist(), *iy[c].tolist()], [*rows.tolist(), *cols.tolist()], strict=True) if u != v)


def _links(sequence: DataFrame, pairs: DataFrame, width: int, epsilon: float, threshold: float, tile: int, side: int) -> DataFrame:
    """(node, links, other): how many vectors a node links to, in parts that add up, and nodes that links tie it to.

    Blocks stand in rows of `side`; a task has the blocks of two rows and compares all pairs of them that are asked for, so that a vector is handed on
    once for each row that its own meets."""
    pairs = cut(pairs.select("i", "j", F.floor(F.col("i") / side).alias("r"), F.floor(F.col("j") / side).alias("s")))
    asked = cut(pairs.select("r", "s", F.explode(F.array("i", "j")).alias("at")).distinct())
    vectors = sequence.join(asked, "at").select("r", "s", "at", "rep", "embedding", "along", "copies")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = left["at"].to_numpy()
        order = np.argsort(at, kind="stable")
        x = matrix(left["embedding"].combine_chunks(), width)[order]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        dims = len(left["along"][0]) if len(at) else 1
        along, nodes, copies, at = matrix(left["along"].combine_chunks(), dims)[order], left["rep"].to_numpy()[order], left["copies"].to_numpy()[order], at[order]
        cuts = np.searchsorted(at, [*(found := np.unique(at)), np.iinfo(np.int64).max])
        blocks = {int(b): (x[u:v], along[u:v], nodes[u:v], copies[u:v]) for b, u, v in zip(found, cuts[:-1], cuts[1:], strict=True)}
        links: dict[int, int] = {}
        ties: set[tuple[int, int]] = set()
        for i, j in zip(right["i"].to_pylist(), right["j"].to_pylist(), strict=True):
            _compare(blocks[i], None if i == j else blocks[j], epsilon, threshold, tile, links, ties)
        out = [(node, n, node) for node, n in links.items()] + [(u, 0, v) for u, v in ties]
        return pa.table([pa.array(v, pa.int64()) for v in (zip(*out, strict=True) if out else ([], [], []))], names=["node", "links", "other"])

    return vectors.groupBy("r", "s").cogroup(pairs.groupBy("r", "s")).applyInArrow(run, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = 4096, tile: int = 256, dims: int = 8, sample: int = 10_000, side: int = 8) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding).

    Links join rows whose cosine is at least threshold; component_id is the least vec_id that links reach and kept marks the row that bears it. Vectors
    that are null, zero or hold null or non-finite components link with nothing, and vectors link only with ones of their own length. Equal vectors are
    compared once and count as often as they occur, so a row's copies are among its links. Rows without vec_id take part in no link. Rows that share a
    vec_id are one node of the components. Further columns are ignored; an empty table gives no rows. The steps inside a pair of blocks emit a few
    rows for each vector, never all pairs of a group.
    """
    rows = vectors.select("vec_id", "embedding")
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    groups = cut(rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    epsilon = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    found = None
    for width in sorted(r[0] for r in groups.select(F.size("embedding")).distinct().collect()):  # as many as there are lengths of vectors
        reps = groups.where(F.size("embedding") == width).select("rep", F.col("embedding").cast("array<double>").alias("embedding"), "copies")
        axes = principal_directions(reps, width, min(dims, width), sample)
        # a block of long vectors has fewer of them, so that a task's two rows of blocks stay small
        sequence = cut(_sequence(reps, width, axes, epsilon, max(32, min(block, _BLOCK_NUMBERS // width))))
        boxes = sequence.groupBy("at").agg(*[f(F.col("along")[k]).alias(f"{n}{k}") for k in range(axes.shape[1]) for n, f in (("l", F.min), ("h", F.max))])
        part = _links(sequence, block_pairs(boxes, axes.shape[1], epsilon), width, epsilon, threshold, tile, side)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    sums = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("node").alias("src"), F.col("other").alias("dst"))).select(F.col("node").alias("rep"), "component")
    known = groups.join(sums, "rep", "left").join(component, "rep", "left").select(
        F.col("embedding").alias("__e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.withColumn("__good", good).join(known, F.when(F.col("__good"), F.col("embedding")) == F.col("__e"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = None  # all pairs are too slow in SQL on whole tables; tests/llm holds it against brute force
