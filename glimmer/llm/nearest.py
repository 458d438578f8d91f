"""Approximate nearest neighbours by collision-counting hashing.

Vectors are scaled to unit length and projected on ``projections`` random lines; each line keeps its values
sorted. A query opens a window around its own value on every line and widens all windows step by step
(virtual rehashing: nothing is hashed again). A vector that lies in at least ``threshold`` windows is verified by its
exact cosine on the original vectors. The threshold is the number of lines, with half-width w, on which a vector at
r = w / SPAN is expected to collide (less ``deviations`` standard deviations, for more recall and less pruning); a query
ends once its k best verified vectors lie within r. Windows widen until that holds or every vector is verified, so no
query comes back short.

Vectors and queries are dealt into blocks by hash; each pair of blocks is one task of bounded memory, and the k best
per block are merged. A vector travels once per block of queries and a query once per block of vectors, so up to
``QUERY_BLOCK`` queries every vector travels once. Vectors that are null, zero, or hold a null or non-finite component take no part; vectors of
other lengths are compared only with their like. A query's own vec_id is no candidate (nor are rows that repeat it);
repeated query rows count once. Ties go to the smaller vec_id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.common import give_back, prepare

PROJECTIONS = 128
#: Standard deviations by which the threshold lies under the collisions that are expected at the radius.
DEVIATIONS = 0.75
#: Half-width of the windows over the radius that it serves.
SPAN = 0.7
FIRST_WIDTH, WIDEN = 0.2, 1.2
VECTOR_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 14


def threshold(projections: int, deviations: float = DEVIATIONS) -> int:
    """Collisions that make a vector be verified."""
    p = math.erf(SPAN / math.sqrt(2))
    return max(1, math.floor(projections * p - deviations * math.sqrt(projections * p * (1 - p))))


class SortedLines:
    """The sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, deviations: float = DEVIATIONS, seed: int = 11):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        values = (vectors / self.norms[:, None]) @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(values, self.order.T.astype(np.int64), axis=0).T.copy()
        self.need = threshold(projections, deviations)
        self.verified = 0

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact cosines in double precision."""
        return (self.vectors[at] * query).sum(axis=1) / (self.norms[at] * np.sqrt((query * query).sum()))

    def search(self, queries: np.ndarray, own: list[np.ndarray], names: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, scores) of the k best found for each query; own: positions that are no candidates."""
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        at = unit @ self.lines
        n, m = len(self.vectors), self.order.shape[0]
        counts = np.zeros((len(queries), n), np.uint8 if m < 256 else np.uint16)
        low = np.stack([np.searchsorted(self.sorted[j], at[:, j]) for j in range(m)], axis=1)
        high = low.copy()
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        seen = np.zeros((len(queries), n), bool)
        for q, mine in enumerate(own):
            seen[q, mine] = True
        live, width = np.arange(len(queries)), FIRST_WIDTH
        while live.size:
            radius = width / SPAN
            last = radius >= 2
            new_low = np.stack([np.searchsorted(self.sorted[j], at[live, j] - width) for j in range(m)], axis=1)
            new_high = np.stack([np.searchsorted(self.sorted[j], at[live, j] + width, side="right") for j in range(m)], axis=1)
            over = np.zeros(live.size, bool)
            for i, q in enumerate(live.tolist()):
                if last:
                    fresh = np.flatnonzero(~seen[q])
                else:
                    parts = [self.order[j, a:b] for j in range(m) for a, b in ((new_low[i, j], low[q, j]), (high[q, j], new_high[i, j])) if b > a]
                    if parts:
                        counts[q] += np.bincount(np.concatenate(parts), minlength=n).astype(counts.dtype)
                    low[q], high[q] = np.minimum(low[q], new_low[i]), np.maximum(high[q], new_high[i])
                    fresh = np.flatnonzero((counts[q] >= self.need) & ~seen[q])
                if fresh.size:
                    seen[q, fresh] = True
                    self.verified += fresh.size
                    where, score = np.concatenate((best[q][0], fresh)), np.concatenate((best[q][1], self.scores(queries[q], fresh)))
                    top = np.lexsort((names[where], -score))[:k]
                    best[q] = (where[top], score[top])
                found = best[q][1]
                over[i] = last or (found.size == k and 2 - 2 * found[-1] <= radius * radius)
            live, width = live[~over], width * WIDEN
        return best


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, projections: int = PROJECTIONS, deviations: float = DEVIATIONS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of largest cosine for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.size(embedding).alias("dim"))
    n, nq = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks = max(1, math.ceil(n / VECTOR_BLOCK))
    query_blocks = max(1, math.ceil(nq / QUERY_BLOCK), spark.sparkContext.defaultParallelism // blocks)  # no fewer tasks than cores
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    left = rows.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).select("vec_id", "v", "dim", "vb", every(query_blocks).alias("qb"))
    right = rows.where("q").dropDuplicates(["vec_id"]).withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).select("vec_id", "v", "dim", "qb", every(blocks).alias("vb"))

    def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, dim)

    def search(key, a, b):
        out = {"query_id": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            dim = key[0].as_py()
            names, asks = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            by_name = np.argsort(names, kind="stable")
            lo, hi = np.searchsorted(names[by_name], asks), np.searchsorted(names[by_name], asks, side="right")
            lines, queries = SortedLines(matrix(a.column("v"), dim), projections, deviations), matrix(b.column("v"), dim)
            for s in range(0, len(asks), 128):
                e = min(s + 128, len(asks))
                for q, (at, score) in enumerate(lines.search(queries[s:e], [by_name[x:y] for x, y in zip(lo[s:e], hi[s:e], strict=True)], names, k), s):
                    out["query_id"] += [int(asks[q])] * len(at)
                    out["vec_id"] += names[at].tolist()
                    out["score"] += score.tolist()
        give_back()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["dim", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
