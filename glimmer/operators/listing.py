"""Listings of the catalog: filters, type resolution, pages with cursors, pages by type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def of_mime(mime: Column, kind: str) -> Column:
    """MIME prefix of a kind; images also where there is no MIME type."""
    hit = F.coalesce(mime.startswith(kind + "/"), F.lit(False))
    return hit | mime.isNull() | (mime == "") if kind == "image" else hit


def holds(words: str, *columns: Column) -> Column:
    """The text occurs in any of the columns, whatever its letter case; wildcards mean themselves."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(words.lower())), F.lit(False)) for c in columns])


def counted_search(rows: DataFrame, words: str, columns: list[str], order: list[Column], limit: int) -> DataFrame:
    """A page of the rows that hold the text, each with ``total``, the number of all of them (an aggregate of one row)."""
    found = rows.where(holds(words, *[F.col(c) for c in columns]))
    return found.orderBy(*order).limit(limit).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


def missing_caption(caption: Column) -> Column:
    return blank(caption)


def missing_embedding(caption: Column, embedding: Column) -> Column:
    return ~blank(caption) & embedding.isNull()


def work_list(rows: DataFrame, caption_status: str, embedding_status: str, stage: str, order: list[Column], limit: int) -> DataFrame:
    """What waits for ``stage``: captions that are pending, or embeddings that are while the caption is done."""
    waits = F.col(caption_status) == "pending" if stage == "caption" else (F.col(caption_status) == "completed") & (F.col(embedding_status) == "pending")
    return rows.where(waits).orderBy(*order).limit(limit)


def of_sources(source: Column, sources: list[str]) -> Column:
    """The given sources, and rows without one."""
    return source.isNull() | (source == "") | source.isin(sources)


def media_type(kind: Column, mime: Column, video_anywhere: bool = False) -> Column:
    """MIME first, then an exact 'video' (or one anywhere in the name), then anything with 'audio', else image."""
    m, k = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    video = F.contains(k, F.lit("video")) if video_anywhere else k == "video"
    return F.when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio").when(video, "video").when(F.contains(k, F.lit("audio")), "audio").otherwise("image")


def sort_date(*dates: Column) -> Column:
    """The first date that is there, else the epoch."""
    return F.coalesce(*dates, F.lit(0))


def segments_up_to(segments: DataFrame, last_pass: int) -> DataFrame:
    """Segments of passes up to ``last_pass`` that nothing supersedes, by priority and pass, highest first (ties by id)."""
    return segments.where((F.col("pass") <= last_pass) & F.col("superseded_by").isNull()).orderBy(F.desc("priority"), F.desc("pass"), "id")


def skip_done(status: Column, force: bool = False) -> Column:
    return F.lit(False) if force else F.coalesce(status == "completed", F.lit(False))


ORDERS = ("created_at", "modified_at", "path", "size")


def cursor_page(rows: DataFrame, order: str, after: tuple | None = None, descending: bool = True, limit: int = 20, key: str = "id") -> DataFrame:
    """``page_after`` in one of the orders that a listing offers."""
    if order not in ORDERS:
        raise ValueError(f"no order by {order}")
    return page_after(rows, order, after, descending, limit, key)


def page_after(rows: DataFrame, order: str, after: tuple | None, descending: bool, limit: int, key: str) -> DataFrame:
    """A page in (order, key) after the cursor (value, key), with has_more on every row and next_key / next_value on the last.

    One row more than the page is taken to see whether others follow. Rows without a value come last, by key; a cursor whose value
    is None lies among them.
    """
    if after is not None:
        v, k = after
        past = F.col(key) < F.lit(k) if descending else F.col(key) > F.lit(k)
        if v is None:
            rows = rows.where(F.col(order).isNull() & past)
        else:
            further = F.col(order) < F.lit(v) if descending else F.col(order) > F.lit(v)
            rows = rows.where(further | ((F.col(order) == F.lit(v)) & past) | F.col(order).isNull())
    by = [F.col(order).desc_nulls_last(), F.col(key).desc()] if descending else [F.col(order).asc_nulls_last(), F.col(key).asc()]
    page = rows.orderBy(*by).limit(limit + 1)
    w = Window.partitionBy().orderBy(*by)  # over limit + 1 rows
    page = page.withColumn("rn", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit).where(F.col("rn") <= limit)
    last = (F.col("rn") == limit) & F.col("has_more")
    return page.withColumn("next_value", F.when(last, F.col(order))).withColumn("next_key", F.when(last, F.col(key)))


def pages_by_type(rows: DataFrame, kind: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """offset .. offset + limit of each type with the type's total and has_more; totals are one row a type, ranks are cut task by task."""
    totals = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("total"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("rn") <= offset + limit)
    return ranked.where(F.col("rn") > offset).join(F.broadcast(totals), kind).withColumn("has_more", F.col("total") > offset + limit)


def with_cursors(pages: DataFrame, kind: str, order: str, key: str, limit: int) -> DataFrame:
    """Per type the cursor after its page (rows ranked by ``rn``): value, key, and whether more can follow."""
    return pages.groupBy(kind).agg(F.max_by(F.struct(order, key), "rn").alias("c"), (F.max("rn") >= limit).alias("has_more")).select(kind, F.col(f"c.{order}").alias("cursor_value"), F.col(f"c.{key}").alias("cursor_key"), "has_more")
