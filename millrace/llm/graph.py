"""Connected components of an edge list, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the least node that links reach.

    Each round hangs every larger neighbour of a node on the node's least neighbour, then does the same among smaller neighbours, until nothing
    changes; rounds grow with the logarithm of the longest path. Every round is written to the shared folder, and deleted after the next. Null ends and
    loops are ignored.
    """
    cur = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    cur = cut(cur)
    nodes, before = cur, _marks(cur)
    while before[0]:
        # every node's larger neighbours move to the least of its neighbours and itself
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        # written before it is joined, so that Spark can split the rows of a node with very many neighbours
        own = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(own, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node and its smaller neighbours move to the least of these
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"))
        small = large.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("n", "m")).distinct()
        last, cur = cur, cut(small)
        discard(own, large, least, *([last] if last is not nodes else []))
        after = _marks(cur)
        if after == before:
            break
        before = after
    ends = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    found = ends.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
    return found.select("node", F.coalesce("component", "node").alias("component"))
