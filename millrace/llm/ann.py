"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Vectors are dealt by a hash into shards of bounded size, and each shard builds its own graph: vectors enter in batches, a greedy beam search over the
graph so far proposes neighbours, and relaxed distance pruning keeps a candidate only if no kept neighbour is much nearer to it than the vector
itself, which leaves edges in diverse directions. Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2). Blocks of queries then
run a beam search over every shard, and the best of all shards, scored again in double precision on the original vectors, are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, parts, read_table
from millrace.llm.vectors import matrix, usable

NAME = "op4_nearest_neighbours"


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, width: int = 4) -> np.ndarray:
    """The beam (queries x beam nodes, nearest first, -1 where there are fewer) that a greedy search from the entries ends with.

    graph holds each node's neighbours, padded with -1. Every round each query expands its `width` nearest nodes that it has not expanded."""
    n, q = len(x), len(queries)
    norms = (x * x).sum(1)
    seen = np.zeros((q, n + 1), bool)
    seen[:, -1] = True
    ids = np.full((q, beam), n, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    first = entries[:beam]
    ids[:, : len(first)] = first
    dist[:, : len(first)] = norms[first] - 2 * queries @ x[first].T
    done[:, : len(first)] = False
    seen[:, first] = True
    at = np.arange(q)
    while True:
        order = np.argsort(np.where(done, np.inf, dist), axis=1)[:, :width]
        rows = np.arange(len(at))[:, None]
        fresh = ~done[rows, order]
        live = fresh.any(1)
        if not live.any():
            break
        done[rows, order] = True
        picked = np.where(fresh, ids[rows, order], n)
        near = np.where(picked[:, :, None] < n, graph[np.minimum(picked, n - 1)], -1).reshape(len(at), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[rows, near], n, near)  # -1 is the last column, which counts as seen
        seen[rows, near] = True
        safe = np.minimum(near, n - 1)
        d = np.where(near < n, norms[safe] - 2 * np.matmul(x[safe], queries[:, :, None])[:, :, 0], np.inf).astype(np.float32)
        all_d = np.concatenate([dist, d], 1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist = all_d[rows, best]
        ids = np.concatenate([ids, near], 1)[rows, best]
        done = np.concatenate([done, near == n], 1)[rows, best] | (ids == n)
    order = np.argsort(dist, axis=1, kind="stable")
    out = np.take_along_axis(ids, order, 1)
    return np.where(out < n, out, -1)


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """nodes x degree: of each node's candidates (padded with -1), nearest first, those to which no kept one is nearer by the factor `relax`."""
    b = len(nodes)
    candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    safe = np.maximum(candidates, 0)
    v = x[safe]
    sq = (v * v).sum(2)
    to_node = np.where(candidates >= 0, sq + (x[nodes] ** 2).sum(1)[:, None] - 2 * np.matmul(v, x[nodes][:, :, None])[:, :, 0], np.inf)
    keep = min(candidates.shape[1], 4 * degree)
    nearest = np.argsort(to_node, axis=1)[:, :keep]
    candidates, to_node, v, sq = (np.take_along_axis(a, nearest if a.ndim == 2 else nearest[:, :, None], 1) for a in (candidates, to_node, v, sq))
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, out = candidates >= 0, np.full((b, degree), -1, np.int64)
    rows = np.arange(b)
    for k in range(degree):
        any_left = alive.any(1)
        if not any_left.any():
            break
        pick = alive.argmax(1)
        out[:, k] = np.where(any_left, candidates[rows, pick], -1)
        alive &= ~(any_left[:, None] & (relax * relax * between[rows, pick] <= to_node))
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, degree: int = 32, beam: int = 64, relax: float = 1.15, batch: int = 512, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The graph over x (nodes x degree) and the entry points of searches: random nodes and the one nearest the centre."""
    n, rng = len(x), np.random.default_rng(seed)
    order = rng.permutation(n)
    centre = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    start = min(n, 2 * degree)
    head = order[:start]
    if start > 1:
        graph[head] = prune(x, head, np.tile(head, (start, 1)), degree, relax)
    for lo in range(start, n, batch):
        new = order[lo : lo + batch]
        found = search(x, graph, x[new], order[: min(lo, beam // 2)], beam)
        peers = np.tile(new, (len(new), 1)) if len(new) <= 1 else new[np.argpartition((x[new] ** 2).sum(1)[None, :] - 2 * x[new] @ x[new].T, min(16, len(new) - 1), axis=1)[:, :17]]
        graph[new] = prune(x, new, np.concatenate([found, peers], 1), degree, relax)
        # edges back: a node with more than `degree` neighbours is pruned again
        src, dst = np.repeat(new, degree), graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for i in range(0, len(nodes), 2048):
            own, f, c = nodes[i : i + 2048], first[i : i + 2048], np.minimum(count[i : i + 2048], 2 * degree)
            cols = np.arange(c.max())[None, :]
            back = np.where(cols < c[:, None], src[np.minimum(f[:, None] + cols, len(src) - 1)], -1)
            graph[own] = prune(x, own, np.concatenate([graph[own], back], 1), degree, relax)
    return graph, np.unique(np.r_[order[: beam // 2], centre])


def _raised(x: np.ndarray) -> np.ndarray:
    """float32 vectors with one more coordinate, after which the nearest to a query (with 0 there) has the largest inner product."""
    norms = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], 1).astype(np.float32)


def index(vectors: DataFrame, shard_rows: int = 8192, k: int = 20, degree: int = 32, beam: int = 64) -> DataFrame:
    """One row per shard: (width, shard, ids, sizes, data, graph, entries). Every usable vector is in one; equal vectors are one node with its k + 1 least ids."""
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # of equal vectors each task hands on k + 1 rows at most
    least = rows.distinct().withColumn("n", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    nodes = cut(least.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("width", F.size("embedding")))
    counts = nodes.groupBy("width").count().withColumn("shards", F.ceil(F.col("count") / shard_rows)).select("width", "shards")
    dealt = nodes.join(F.broadcast(counts), "width").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))  # a row for each length of vectors

    def run(key, tables):
        table, width = tables, key[0].as_py()
        x = matrix(table.column("embedding").combine_chunks(), width)
        lists = table.column("ids").combine_chunks()
        by = np.lexsort(x.T[::-1])  # the same graph whatever the order of the rows
        x = x[by]
        held = [lists[int(i)].as_py() for i in by]
        graph, entries = build(_raised(x), degree, beam)
        flat = np.array([i for h in held for i in h], np.int64)
        return pa.table({"width": pa.array([width], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "ids": [flat.tobytes()], "sizes": [np.array([len(h) for h in held], np.int32).tobytes()], "data": [x.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entries": [entries.astype(np.int32).tobytes()]})

    schema = "width int, shard int, ids binary, sizes binary, data binary, graph binary, entries binary"
    built = dealt.select("width", "shard", F.col("embedding").cast("array<double>").alias("embedding"), "ids").repartition(parts(vectors.sparkSession), "width", "shard").groupBy("width", "shard").applyInArrow(run, schema)
    return cut(built)


def nearest(queries: DataFrame, indexed: DataFrame, k: int = 20, beam: int = 128, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest that the shards' graphs yield for each row of queries (vec_id, embedding).

    A query's own vec_id is no candidate. Queries that are null, zero or hold null or non-finite components have no result, nor do queries whose
    length no indexed vector has; ties go to the smaller vec_id; with fewer than k candidates all that are found are returned. Of queries that repeat a vec_id one counts.
    """
    rows = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding"))
    blocks = -(-rows.count() // block)
    grouped = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))).groupBy("width", "block").agg(F.collect_list("vec_id").alias("q_ids"), F.flatten(F.collect_list("embedding")).alias("q_data"))
    # every block of queries meets every shard of its width
    shards = indexed.select(F.col("width").alias("w"), "shard")
    pairs = grouped.join(shards, F.col("width") == F.col("w")).drop("w").repartition(parts(queries.sparkSession), "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(i)[r] for i, name in enumerate(b.schema.names)}
                width = row["width"].as_py()
                x = np.frombuffer(row["data"].as_py()).reshape(-1, width)
                graph = np.frombuffer(row["graph"].as_py(), np.int32).reshape(len(x), -1)
                entries = np.frombuffer(row["entries"].as_py(), np.int32)
                sizes, ids = np.frombuffer(row["sizes"].as_py(), np.int32), np.frombuffer(row["ids"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                q_ids, q = np.asarray(row["q_ids"].values), np.asarray(row["q_data"].values, dtype=np.float64).reshape(-1, width)
                raised = _raised(x)
                for lo in range(0, len(q), 256):
                    part = q[lo : lo + 256]
                    found = search(raised, graph, np.concatenate([part, np.zeros((len(part), 1))], 1).astype(np.float32), entries, beam)
                    scores = np.einsum("qbd,qd->qb", x[np.maximum(found, 0)], part)
                    outs = ([], [], [])
                    for i in range(len(part)):
                        nodes = found[i][found[i] >= 0]
                        # of the k + 1 best nodes at most one holds nothing but the query itself
                        cut_at = np.sort(-scores[i][: len(nodes)])[: k + 1][-1] if len(nodes) else 0
                        pick = [j for j in range(len(nodes)) if -scores[i][j] <= cut_at]
                        got = sorted((-scores[i][j], v) for j in pick for v in ids[ends[nodes[j]] - sizes[nodes[j]] : ends[nodes[j]]].tolist() if v != q_ids[lo + i])[:k]
                        outs[0].extend([q_ids[lo + i]] * len(got))
                        outs[1].extend(v for _, v in got)
                        outs[2].extend(-s for s, _ in got)
                    yield pa.RecordBatch.from_arrays([pa.array(outs[0], pa.int64()), pa.array(outs[1], pa.int64()), pa.array(outs[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = pairs.join(indexed, ["width", "shard"]).select("width", "q_ids", "q_data", "ids", "sizes", "data", "graph", "entries").mapInArrow(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 20 = 0"), index(vectors))


ORACLE_SQL = None  # approximate: tests/llm measures recall against brute force
