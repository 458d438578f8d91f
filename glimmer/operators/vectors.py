"""Distances, similarity scorers and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.session import ship_package


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    step = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(step, F.lit(0.0), lambda s, x: s + x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def inverse(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / 25.0)


def exponential(d: Column) -> Column:
    return F.exp(-d / 8.0)


def gaussian(d: Column) -> Column:
    return F.exp(-d * d / 50.0)


def sigmoid(d: Column) -> Column:
    return 1 / (1 + F.exp((d - 15.0) / 2.0))


#: Pieces of the default score (fixed values): below the first number, second - third * (d - fourth).
PIECES = [(13.0, 1.0, 0.05, 12.0), (15.0, 0.95, 0.05, 13.0), (17.0, 0.85, 0.1, 15.0), (20.0, 0.65, 0.1, 17.0)]


def piecewise(d: Column) -> Column:
    """The default score; above 1 for distances under 12."""
    tail = F.greatest(F.lit(0.0), 0.35 - 0.05 * (d - 20.0))
    for below, top, slope, start in reversed(PIECES):
        tail = F.when(d < below, top - slope * (d - start)).otherwise(tail)
    return tail


SCORERS = {"inverse": inverse, "exponential": exponential, "gaussian": gaussian, "sigmoid": sigmoid, "piecewise": piecewise}


def adaptive(df: DataFrame, distance: str = "distance", out: str = "score") -> DataFrame:
    """Distance scaled to 1 (nearest) .. 0 (farthest) of all rows; one distance only: 1. Bounds come from an aggregate."""
    bounds = df.agg(F.min(distance).alias("_lo"), F.max(distance).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(span == 0, F.lit(1.0)).otherwise(1 - (F.col(distance) - F.col("_lo")) / span)).drop("_lo", "_hi")


def knn(vectors: DataFrame, query: list[float], k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest vectors by L2 distance in double precision, ties to the smaller id: one scan and a top k.

    Distances are one matrix operation per Arrow batch, which passes on its k best rows only. Null vectors, other lengths and
    vectors with a null or undefined component take no part.
    """
    ship_package(vectors.sparkSession)
    asked, at, key = np.array(query, np.float64), vectors.columns.index(embedding), vectors.columns.index(vec_id)

    def best(batches):
        for rb in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(rb.column(at)), len(asked)), False)
            rb = rb.filter(fits)
            rows = rb.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(asked))
            d = np.sqrt(((rows - asked) ** 2).sum(axis=1))
            ids = rb.column(key).to_numpy(zero_copy_only=False)
            first = [i for i in np.lexsort((ids, d))[: k + int(np.isnan(d).sum())].tolist() if not np.isnan(d[i])][:k]
            rb = rb.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(d[first])], names=[*rb.schema.names, "distance"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("distance", T.DoubleType())])
    return vectors.mapInArrow(best, schema).orderBy("distance", vec_id).limit(k)


def candidate_count(limit: int, kind: str) -> int:
    """How many candidates each search takes before filters."""
    return {"vector": min(max(4 * limit, 50), 1000), "av": 3 * limit, "image": min(max(3 * limit, 30), 100), "legacy": 2 * limit}[kind]


def relevance_bucket(score: Column) -> Column:
    return F.when(F.coalesce(score, F.lit(0.0)) == 0, "none").when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def min_max_page(df: DataFrame, score: str = "bm25", out: str = "norm") -> DataFrame:
    """Scores of a returned page (lower is better) scaled to 1 .. 0; a single row scores 1. The page is small by its limit."""
    w = Window.partitionBy()
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, 1 - (F.col(score) - lo) / F.when(hi - lo == 0, 1.0).otherwise(hi - lo))


def cosine_page(rows: DataFrame, query: list[float], limit: int, offset: int = 0, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, score): the nearest by cosine from ``offset`` on, of rows that have a vector (ties: the smaller key)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = rows.where(F.col(embedding).isNotNull()).select(key, cosine_similarity(F.col(embedding), q).alias("score"))
    return best.orderBy(F.desc("score"), key).offset(offset).limit(limit)
