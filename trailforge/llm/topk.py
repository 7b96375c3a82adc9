"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Where a few dimensions decide, reading stops early; where all 64 count alike, as
in vectors drawn at random, the bound holds only once nearly all rows have come
up in some list, and each row is scored once all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Candidates and queries that one task holds.
CANDIDATES = 16_384
QUERIES = 1_024


class SortedLists:
    """For each dimension, the rows of a block by falling value, each with its value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        at = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[at], vectors[at]
        self.order = np.argsort(-self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows but the query's own, ties to smaller ids.

        Lists are read from the end that the query's sign favours, to a depth
        that doubles.  Rows seen anywhere are scored in full; no unseen row can
        score more than the sum of the lists' values at that depth, and reading
        ends when this bound is *below* the kth score (a tie may still hide a
        smaller id), or at the lists' ends.  ``read`` counts the rows scored.
        """
        n = len(self.ids)
        used = np.flatnonzero(query)
        down = used[query[used] > 0]
        up = used[query[used] < 0]
        seen = np.zeros(n, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        depth, step = 0, 16
        self.read = 0
        while depth < n:
            to = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[depth:to, down].ravel()] = True
            fresh[self.order[n - to : n - depth, up].ravel()] = True
            if not len(used):
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            depth, step = to, step * 2
            self.read += len(new)
            score = self.vectors[new] @ query
            own = self.ids[new] != query_id
            best_ids, best = np.concatenate([best_ids, self.ids[new][own]]), np.concatenate([best, score[own]])
            if len(best) > k:
                kth = np.partition(best, len(best) - k)[len(best) - k]
                keep = best >= kth
                best_ids, best = best_ids[keep], best[keep]
                first = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[first], best[first]
            if seen.all():
                break
            bound = self.sorted[depth - 1, down] @ query[down] + self.sorted[n - depth, up] @ query[up]
            if len(best) >= k and bound < best.min():
                break
        first = np.lexsort((best_ids, -best))[:k]
        return best_ids[first], best[first]


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v, dims)`` with ``floor(scale * x)`` as long; vectors null, or with null or non-finite components, are left out."""
    x = F.col("v")
    whole = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return whole.where(x.isNotNull() & F.col("id").isNotNull() & ~bad).select("id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"), F.size(x).alias("dims"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for every row whose id divides by ``every``.

    Candidates and queries are dealt to blocks of bounded size, and each block
    of queries meets each block of candidates in a task of its own.  Vectors of
    another length than the query's take no part.  Rows that repeat an id are
    candidates each (but never of a query with that id) and queries each; an
    empty table, or a single row, gives none.  Scores are sums of longs; vectors
    whose products would leave the range of long are an error.
    """
    # written, so that a row stays in its block if its task runs again; blocks are drawn by row, as an id may repeat
    rows = materialize(quantized(vectors, id_col, vector_col, scale), "quantized")
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    by, of = max(1, -(-count.n // CANDIDATES)), max(1, -(-count.q // QUERIES))
    c = rows.withColumn("c", F.floor(F.rand(1) * by)).withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(of - 1).cast("bigint"))))
    q = rows.where(F.col("id") % every == 0).withColumn("q", F.floor(F.rand(2) * of)).withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(by - 1).cast("bigint"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            held, asked = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            if held.shape[1]:
                reach = float(np.abs(held).max()) * float(np.abs(asked).max()) * held.shape[1]
                if reach >= 2**63:
                    raise OverflowError("scores would leave the range of long")
                if reach < 2**53:  # exact, and products of doubles are faster
                    held, asked = held.astype(np.float64), asked.astype(np.float64)
            lists = SortedLists(left["id"].to_numpy(), held)
            for i, v in zip(right["id"].tolist(), asked, strict=True):
                ids, scores = lists.top(i, v, k)
                out += zip([i] * len(ids), ids.tolist(), map(int, scores.tolist()), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["c", "q", "dims"]
    found = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the five best of all vectors for every fiftieth."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
