"""What a caller can plug in: search stores that return pages of (id, score), sources that list items, and the merge of stores."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.operators import search, vectors


class SearchStore(Protocol):
    """A page of results: id, score (higher is better), created_at."""

    def search(self, query: str, limit: int) -> DataFrame: ...


class Source(Protocol):
    """A table of items: id, path, type."""

    def items(self, spark: SparkSession) -> DataFrame: ...


def of_type(page: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """The page's rows whose catalog type begins with ``kind``, after retrieval, so that fewer than its limit may be left."""
    return search.with_metadata(page, catalog.where(F.col("type").startswith(kind)), "id")


class VectorStore:
    """Nearest vectors alone, scored by a function of the distance; ``embed`` turns a query into a vector."""

    def __init__(self, embeddings: DataFrame, catalog: DataFrame, embed, kind: str, scorer=vectors.piecewise):
        self.embeddings, self.catalog, self.embed, self.kind, self.scorer = embeddings, catalog, embed, kind, scorer

    def search(self, query: str, limit: int) -> DataFrame:
        page = vectors.knn(self.embeddings, self.embed(query), vectors.candidate_count(limit, "vector"), vec_id="id")
        found = of_type(page.select("id", self.scorer(F.col("distance")).alias("score")), self.catalog, self.kind)
        return found.select("id", "score", "created_at").orderBy(F.desc("score"), "id").limit(limit)


class TextStore:
    """Full text alone: BM25 of any of the query's words, scaled within the page."""

    def __init__(self, spark: SparkSession, postings: str, catalog: DataFrame, kind: str):
        self.spark, self.postings, self.catalog, self.kind = spark, postings, catalog, kind

    def search(self, query: str, limit: int) -> DataFrame:
        words = search.phrases([w for w in query.lower().split() if w])
        page = search.ranked_top(self.spark, self.postings, words, limit)
        page = vectors.min_max_page(page).select(F.col("doc_id").alias("id"), F.col("norm").alias("score"))
        return of_type(page, self.catalog, self.kind).select("id", "score", "created_at")


def search_all(stores: list[SearchStore], query: str, limit: int) -> DataFrame:
    """The best ``limit`` results of all stores, each asked for that many: id, score, created_at, place; and on every row the total that
    the stores found, the greatest depth that one searched, whether more may follow, and the cursor (time and id of the last
    result, where the page is full and that result has a time).

    A store's page may have columns total and depth of its own; else its rows are counted, and its depth is 1.
    """
    pages = []
    for k, s in enumerate(stores):
        page = s.search(query, limit)
        own = lambda c, other, page=page: (F.col(c) if c in page.columns else F.lit(other)).cast("long").alias(f"_{c}")
        pages.append(page.select("id", "score", "created_at", own("total", None), own("depth", 1), F.lit(k).alias("_store")))
    every = reduce(DataFrame.unionByName, pages)  # at most limit rows a store
    by_store = every.groupBy("_store").agg(F.coalesce(F.max("_total"), F.count(F.lit(1))).alias("t"), F.max("_depth").alias("d"))
    told = by_store.agg(F.sum("t").alias("total"), F.max("d").alias("depth"))
    order = [F.col("score").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id")]
    page = every.select("id", "score", "created_at", F.row_number().over(Window.orderBy(*order)).alias("place")).where(F.col("place") <= limit)
    last = page.where(F.col("place") == limit).agg(F.max("created_at").alias("next_at"), F.max("id").alias("next_id"))  # one row, nulls where the page is not full
    out = page.crossJoin(F.broadcast(told)).crossJoin(F.broadcast(last))
    return out.withColumns({"next_id": F.when(F.col("next_at").isNotNull(), F.col("next_id")), "has_more": F.col("next_at").isNotNull() & (F.col("total") > 0)}).orderBy("place")


def phase_stats(items: DataFrame, caption: Column, embedding: Column) -> DataFrame:
    """Totals of the two phases in one pass: captions and embeddings that are done, pending or failed."""
    at = lambda c, s, n: F.count_if(c == s).alias(n)
    return items.agg(F.count(F.lit(1)).alias("total"), *[at(c, s, f"{n}_{s}") for n, c in (("caption", caption), ("embedding", embedding)) for s in ("completed", "pending", "failed")])
