"""Fusion of ranked lists: weighted hybrid, reciprocal rank, two-depth union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hybrid(vector: DataFrame, text: DataFrame, alpha: float, min_vector: float, min_score: float, limit: int, skip_cut_without_text: bool = False) -> DataFrame:
    """Full outer join of (id, vs) and (id, fs), a missing side scoring 0; alpha vs + (1 - alpha) fs; top ``limit``.

    Both sides are pages of bounded size. With ``skip_cut_without_text`` the score cut-off holds only if the text search found anything.
    """
    both = vector.where(F.col("vs") >= min_vector).join(text, "id", "full_outer")
    both = both.select("id", F.coalesce("vs", F.lit(0.0)).alias("vs"), F.coalesce("fs", F.lit(0.0)).alias("fs"), F.col("fs").isNotNull().alias("in_text"))
    both = both.withColumn("score", alpha * F.col("vs") + (1 - alpha) * F.col("fs"))
    keep = F.col("score") >= min_score
    if skip_cut_without_text:
        both = both.withColumn("n_text", F.count_if("in_text").over(Window.partitionBy()))
        keep = keep | (F.col("n_text") == 0)
    return both.where(keep).select("id", "vs", "fs", "score").orderBy(F.desc("score"), "id").limit(limit)


def reciprocal_rank(lists: DataFrame, k: int = 60) -> DataFrame:
    """(id, score, sources) from (list_name, id, score): sum over lists of 1 / (k + rank), rank from 1."""
    w = Window.partitionBy("list_name").orderBy(F.desc("score"), "id")
    ranked = lists.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("sources"))


def two_depth(first: DataFrame, second: DataFrame, weight_first: float = 0.7, weight_second: float = 0.3, min_results: int = 5) -> DataFrame:
    """(id, score, depth) of two pages. If the first has ``min_results`` rows or more it is the result as it is, at depth 1; else ids in
    both add up their weighted scores, at depth 2. A lazily given second page is not computed for nothing: its rows meet a false filter."""
    n = first.agg(F.count(F.lit(1)).alias("n"))  # one row
    enough = F.col("n") >= min_results
    own = first.crossJoin(F.broadcast(n)).select("id", (F.col("score") * F.when(enough, 1.0).otherwise(weight_first)).alias("score"), F.when(enough, 1).otherwise(2).alias("depth"))
    extra = second.crossJoin(F.broadcast(n)).where(~enough).select("id", (F.col("score") * weight_second).alias("score"), F.lit(2).alias("depth"))
    return own.unionByName(extra).groupBy("id").agg(F.sum("score").alias("score"), F.max("depth").alias("depth"))


def text_and_vector(text: DataFrame, vector: DataFrame, limit: int, offset: int = 0, k: int = 60) -> DataFrame:
    """(id, score, kind, place) from pages (id, score): the best of the text page where the vector page is empty, else both by reciprocal
    ranks, ``offset`` to ``offset + limit``."""
    lists = text.select(F.lit("text").alias("list_name"), "id", "score").unionByName(vector.select(F.lit("vector").alias("list_name"), "id", "score"))
    fused = reciprocal_rank(lists, k).select("id", "score", F.lit("hybrid").alias("kind"))
    any_vector = vector.agg((F.count(F.lit(1)) > 0).alias("any"))  # one row
    both = fused.crossJoin(F.broadcast(any_vector)).where("any").drop("any").unionByName(text.crossJoin(F.broadcast(any_vector)).where(~F.col("any")).select("id", "score", F.lit("text").alias("kind")))
    ranked = both.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # pages are of bounded size
    skip = F.when(F.col("kind") == "hybrid", offset).otherwise(0)
    return ranked.where((F.col("place") > skip) & (F.col("place") <= skip + limit))


def merge_by_score(*stores: DataFrame) -> DataFrame:
    """Results of several stores by score, then creation time, then id; missing values last, ids are not made unique."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out.orderBy(F.col("score").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id")
