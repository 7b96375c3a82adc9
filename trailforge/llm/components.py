"""Connected components by alternating star contraction, on DataFrames alone; few edges are joined on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on that node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, is hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of all edges, sorted, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    head = np.arange(len(nodes))
    while True:
        p, q = head[a], head[b]
        apart = p != q
        if not apart.any():
            return nodes, nodes[head]
        np.minimum.at(head, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (head != (up := head[head])).any():
            head = up


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """``(node, component)`` for every node with an edge; the component is its least node.

    ``edges`` has long columns ``u`` and ``v``.  Each round is two contractions
    (a node's edges are only ever summarised by a minimum, so a hub is combined
    before the shuffle and its rows are spread by the skew join), written to the
    shared folder; rounds end when no edge changes.  Rounds grow with the
    logarithm of the longest chain.  Up to ``few`` edges come to the driver
    instead, which spares it the jobs of all rounds; the result is the same.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    if few and edges.count() <= few:
        got = edges.toArrow()
        nodes, heads = joined(got["u"].to_numpy(), got["v"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "component": heads}), "node bigint, component bigint")
    sign = None
    for _ in range(max_rounds):
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = tuple(edges.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(u, v) as decimal(20,0))), 0)")).first())
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
