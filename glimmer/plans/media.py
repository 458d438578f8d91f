"""Registered queries of the catalog, job, search, keyframe and backfill operators, each with the SQL it is checked against.

The test tables are given the shapes of a media catalog by plain SELECTs that both engines run (``{table}`` names a table).
"""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.operators import backfill as B
from glimmer.operators import intervals, jobs, listing, pages, search, stores, substrings, understanding
from glimmer.operators import keyframes as K
from glimmer.operators import text as text_ops
from glimmer.plans.registry import ORACLES, QUERIES, r6
from glimmer.session import scratch
from glimmer.sources import folders, upserts
from glimmer.sources.catalog import table
from glimmer.streaming import events as streams

MEDIA = """SELECT page_id AS id, 'name ' || CAST(page_id AS STRING) AS name,
    CASE page_id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'image' WHEN 2 THEN 'video_segment' WHEN 3 THEN 'Audio file' ELSE 'other' END AS type,
    CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'video/mp4' WHEN 3 THEN 'audio/mpeg' WHEN 4 THEN 'image/png' ELSE 'text/plain' END AS mime,
    '/m/' || CAST(page_id % 40 AS STRING) || CASE WHEN page_id % 5 = 2 THEN '#t=' || CAST(page_id % 50 AS STRING) || '.5,' || CAST(page_id % 50 + 7 AS STRING) ELSE '' END AS path,
    CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 's1' WHEN 2 THEN '' ELSE 's3' END AS source_id,
    CASE page_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
    CASE page_id % 3 WHEN 0 THEN 'pending' ELSE 'completed' END AS caption_status,
    CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE substr(html, 1, 80) END AS caption,
    CASE WHEN page_id % 9 = 0 THEN 100 END AS deleted_at, CAST(page_id * 37 % 1000 AS BIGINT) AS created_at, CASE WHEN page_id % 2 = 0 THEN CAST(page_id * 17 % 900 AS BIGINT) END AS modified_at,
    CAST(page_id * 31 % 10000 AS BIGINT) AS size, CAST(page_id % 100 AS DOUBLE) / 100 AS score, page_id % 13 AS priority, page_id % 3 + 1 AS pass, CASE WHEN page_id % 8 = 0 THEN page_id + 1 END AS superseded_by
    FROM {pages}"""
JOBS = """SELECT o_orderkey AS id, o_custkey % 40 AS source_id, '/m/' || CAST(o_orderkey % 211 AS STRING) AS path,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 5 = 1 THEN 'running' WHEN o_orderkey % 5 = 2 THEN 'scheduled' WHEN o_orderkey % 5 = 3 THEN 'delayed' ELSE 'pending' END AS status,
    o_orderkey % 4 + 1 AS pass, o_orderkey % 7 AS priority, o_orderkey % 4 AS retries, o_orderkey % 101 AS progress, o_orderkey * 7 % 10000 AS created_at,
    CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey * 7 % 10000 + 50 END AS started_at, o_orderkey * 11 % 10000 AS scheduled_at,
    CASE WHEN o_orderkey % 3 = 0 THEN 'message ' || CAST(o_orderkey % 4 AS STRING) WHEN o_orderkey % 3 = 1 THEN '' END AS message, CASE WHEN o_orderkey % 2 = 0 THEN 'coarse' ELSE 'fine' END AS mode
    FROM {orders}"""
SEGS = """SELECT event_id AS id, user_id AS video, CAST(event_id % 997 AS DOUBLE) AS start, CAST(event_id % 997 AS DOUBLE) + 1 + CAST(event_id * 13 % 40 AS DOUBLE) / 2 AS "end",
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type || ' word' || CAST(event_id % 3 AS STRING) END AS text, CAST(event_id * 7 % 101 AS DOUBLE) / 101 AS score,
    'thumb' || CAST(event_id AS STRING) AS thumbnail, CASE event_id % 3 WHEN 0 THEN 'completed' ELSE 'pending' END AS status FROM {events}"""
FRAMES = """SELECT user_id AS video, event_id AS id, CAST(event_id % 401 AS DOUBLE) / 4 AS t, CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS motion, CAST(event_id * 53 % 97 AS DOUBLE) / 96 AS histogram, CAST(event_id * 29 % 89 AS DOUBLE) / 88 AS complexity,
    CAST(event_id * 41 % 103 AS DOUBLE) / 102 AS scene, CASE event_id % 4 WHEN 0 THEN 'I' ELSE CASE event_id % 9 WHEN 1 THEN 'I' ELSE 'P' END END AS type FROM {events}"""


def frame(spark, sf_dir, sql):
    """The rows of a portable SELECT."""
    sql = sql.replace('"', "`")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def plain(sql: str) -> str:
    return re.sub(r"[{}]", "", sql)


M, J, S, V = (plain(x) for x in (MEDIA, JOBS, SEGS, FRAMES))
NOW = 9000


def unit_sql(text: str) -> str:
    """keyframes.unit_hash in SQL."""
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT % 1000) / 999e0)"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir); m, j, s, v stand for the four shapes in its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            shapes = ", ".join(f"{n} AS ({x})" for n, x in (("m", M), ("j", J), ("s", S), ("v", V)) if re.search(rf"\b{n}\b", sql))
            rest = sql.strip()
            head = "WITH RECURSIVE " if "RECURSIVE" in rest else "WITH "
            rest = re.sub(r"^WITH (RECURSIVE )?", "", rest) if rest.startswith("WITH") else rest
            ORACLES[f.__name__] = (head + shapes + (", " if sql.strip().startswith("WITH") else " ") + rest) if shapes else sql
        return f

    return add


media = lambda spark, sf: frame(spark, sf, MEDIA)
job = lambda spark, sf: frame(spark, sf, JOBS)
segs = lambda spark, sf: frame(spark, sf, SEGS)
frames = lambda spark, sf: frame(spark, sf, FRAMES)

# ---- listings


@query("SELECT id FROM m WHERE mime LIKE 'image/%' OR mime IS NULL OR mime = ''")
def mime_filter(spark, sf):
    return media(spark, sf).where(listing.of_mime(F.col("mime"), "image")).select("id")


@query("SELECT id, count(*) OVER () AS total FROM m WHERE contains(lower(path), '/m/1') ORDER BY created_at DESC, id LIMIT 10")
def counted_search(spark, sf):
    return listing.counted_search(media(spark, sf), "/M/1", ["path"], [F.desc("created_at"), F.col("id")], 10).select("id", "total")


def trigrams(spark, rows, key, columns):
    path = scratch(spark, "trigrams")
    substrings.write_trigrams(rows, path, key, columns)
    return path


@query("SELECT id, count(*) OVER () AS total FROM m WHERE contains(lower(path), '/m/12') OR contains(lower(caption), '/m/12') ORDER BY created_at DESC, id LIMIT 10")
def indexed_counted_search(spark, sf):
    m, columns = media(spark, sf), ["name", "path", "caption"]
    found = substrings.holding(m, trigrams(spark, m, "id", columns), "/M/12", "id", columns, ["path", "caption"])
    return listing.counted_search(found, "/M/12", ["path", "caption"], [F.desc("created_at"), F.col("id")], 10).select("id", "total")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the') UNION ALL SELECT doc_id FROM documents WHERE contains(lower(text), 'zz')")
def indexed_text_search(spark, sf):
    """A needle of several trigrams, and one that is too short to have any."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    path = trigrams(spark, d, "doc_id", ["text"])
    return reduce(DataFrame.unionByName, [substrings.holding(d, path, w, "doc_id", ["text"]).select("doc_id") for w in ("TION the", "zz")])


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 1 UNION ALL SELECT -CAST(o_orderkey AS BIGINT), 'added' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey > 0")
def upserted_table(spark, sf):
    """Orders written, a third replaced, some added that a repeated run leaves alone, a seventh deleted."""
    o, path = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status")), scratch(spark, "upserts")
    upserts.write_changes(o, path, "id", buckets=16)
    upserts.write_changes(o.where("id % 3 = 0").withColumn("status", F.lit("new")), path, "id", buckets=16)
    for status in ("added", "ignored"):
        upserts.write_changes(o.where("id % 5 = 0").select((-F.col("id")).alias("id"), F.lit(status).alias("status")), path, "id", keep_old=True, buckets=16)
    upserts.write_changes(o.where("false"), path, "id", gone=o.where("id % 7 = 1"), buckets=16)
    return upserts.read_table(spark, path)


@query("SELECT id FROM m WHERE contains(lower(name), '1') OR contains(lower(path), '1') OR contains(lower(caption), '1')")
def name_path_caption_search(spark, sf):
    return media(spark, sf).where(listing.holds("1", F.col("name"), F.col("path"), F.col("caption"))).select("id")


@query("SELECT id, caption IS NULL OR trim(caption) = '' AS no_caption, NOT (caption IS NULL OR trim(caption) = '') AND modified_at IS NULL AS no_embedding FROM m")
def missing_work(spark, sf):
    return media(spark, sf).select("id", listing.missing_caption(F.col("caption")).alias("no_caption"), listing.missing_embedding(F.col("caption"), F.col("modified_at")).alias("no_embedding"))


@query("SELECT id FROM m WHERE caption_status = 'completed' AND status = 'pending' ORDER BY created_at DESC, id LIMIT 15")
def work_lists(spark, sf):
    return listing.work_list(media(spark, sf), "caption_status", "status", "embedding", [F.desc("created_at"), F.col("id")], 15).select("id")


@query("SELECT id FROM m WHERE deleted_at IS NULL AND (source_id IS NULL OR source_id = '' OR source_id IN ('s1'))")
def live_of_sources(spark, sf):
    return media(spark, sf).where(F.col("deleted_at").isNull() & listing.of_sources(F.col("source_id"), ["s1"])).select("id")


@query("""SELECT id, CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN lower(type) = 'video' THEN 'video' WHEN contains(lower(type), 'audio') THEN 'audio' ELSE 'image' END AS kind,
    CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN contains(lower(type), 'video') THEN 'video' WHEN contains(lower(type), 'audio') THEN 'audio' ELSE 'image' END AS ui_kind,
    coalesce(modified_at, created_at, 0) AS sort_date FROM m WHERE type <> 'video_segment'""")
def media_types(spark, sf):
    kind = lambda anywhere: listing.media_type(F.col("type"), F.col("mime"), anywhere)
    return media(spark, sf).where("type <> 'video_segment'").select("id", kind(False).alias("kind"), kind(True).alias("ui_kind"), listing.sort_date(F.col("modified_at"), F.col("created_at")).alias("sort_date"))


@query("SELECT id, row_number() OVER (ORDER BY priority DESC, pass DESC, id) AS place FROM m WHERE pass <= 2 AND superseded_by IS NULL")
def standing_segments(spark, sf):
    from pyspark.sql import Window

    kept = listing.segments_up_to(media(spark, sf), 2)
    return kept.select("id", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("pass"), "id")).cast("long").alias("place"))


@query("SELECT id, coalesce(status = 'completed', false) AS skip FROM m")
def skip_completed(spark, sf):
    return media(spark, sf).select("id", listing.skip_done(F.col("status")).alias("skip"))


@query("""WITH p AS (SELECT * FROM m WHERE size IS NULL OR size < 5000 OR (size = 5000 AND id < 100) ORDER BY size DESC NULLS LAST, id DESC LIMIT 21), r AS (SELECT *, row_number() OVER (ORDER BY size DESC NULLS LAST, id DESC) AS rn, count(*) OVER () > 20 AS has_more FROM p)
    SELECT id, size, has_more, CASE WHEN rn = 20 AND has_more THEN id END AS next_key FROM r WHERE rn <= 20""")
def cursor_page(spark, sf):
    return listing.cursor_page(media(spark, sf), "size", (5000, 100)).select("id", "size", "has_more", "next_key")


@query("""WITH q AS (SELECT id, CASE WHEN id % 7 > 0 THEN size END AS size FROM m), p AS (SELECT * FROM q WHERE size IS NULL AND id > 5 ORDER BY id LIMIT 8), r AS (SELECT *, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () > 7 AS has_more FROM p)
    SELECT id, size, has_more, CASE WHEN rn = 7 AND has_more THEN id END AS next_key FROM r WHERE rn <= 7
    UNION ALL SELECT * FROM (SELECT id, size, false AS has_more, NULL AS next_key FROM q WHERE size IS NULL OR size >= (SELECT max(size) FROM q) ORDER BY size NULLS LAST, id LIMIT 100000)""")
def cursor_pages_without_value(spark, sf):
    """Among the rows that have no value, and the last page, which ends with them."""
    m = media(spark, sf).withColumn("size", F.when(F.col("id") % 7 > 0, F.col("size")))
    most = m.agg(F.max("size").alias("s")).first()["s"]
    among = listing.cursor_page(m, "size", (None, 5), descending=False, limit=7)
    last = listing.cursor_page(m, "size", (most - 1, 1 << 40), descending=False, limit=100_000)
    return among.unionByName(last).select("id", "size", "has_more", "next_key")


#: Pages of one clustered copy: name, cursor, whether descending, rows.
CLUSTERED = [("first", None, True, 20), ("middle", (450, 60), True, 20), ("ascending", (450, 60), False, 20), ("into_none", (10, 1 << 40), True, 200), ("among_none", (None, 77), True, 9), ("end", (None, 1 << 40), False, 5)]


def clustered_sql(name: str, after: tuple | None, descending: bool, limit: int) -> str:
    way, sign = ("DESC", "<") if descending else ("ASC", ">")
    past = "true" if after is None else f"modified_at IS NULL AND id {sign} {after[1]}" if after[0] is None else f"(modified_at {sign} {after[0]} OR (modified_at = {after[0]} AND id {sign} {after[1]}) OR modified_at IS NULL)"
    rank = f"row_number() OVER (ORDER BY modified_at {way} NULLS LAST, id {way})"
    return f"SELECT '{name}' AS page, id, modified_at, n > {limit} AS has_more, CASE WHEN rn = {limit} AND n > {limit} THEN id END AS next_key FROM (SELECT id, modified_at, {rank} AS rn, count(*) OVER () AS n FROM m WHERE {past}) WHERE rn <= {limit}"


@query(" UNION ALL ".join(clustered_sql(*c) for c in CLUSTERED))
def clustered_pages(spark, sf):
    """Pages from the files they lie in, both ways, into the rows without a value, among them, and after the last."""
    path = scratch(spark, "pages")
    pages.write_clustered(media(spark, sf).select("id", "modified_at"), path, "modified_at", "id", file_rows=500)
    found = [pages.clustered_page(spark, path, "modified_at", "id", after, down, limit).select(F.lit(name).alias("page"), "id", "modified_at", "has_more", "next_key") for name, after, down, limit in CLUSTERED]
    return reduce(DataFrame.unionByName, found)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (date_trunc('second', o_orderdate), o_orderkey) < (TIMESTAMP '1997-01-01 00:00:00', 500) ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey DESC LIMIT 21")
def clustered_seconds(spark, sf):
    """The keyset page of orders, compared to the second, from a copy that is clustered by the second."""
    path = scratch(spark, "pages")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz").alias("second"))
    pages.write_clustered(o, path, "second", "o_orderkey", file_rows=2000)
    return pages.clustered_page(spark, path, "second", "o_orderkey", (datetime.datetime(1997, 1, 1), 500), limit=21).select("o_orderkey", "o_orderdate")


@query("""WITH r AS (SELECT type, id, created_at, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS rn, count(*) OVER (PARTITION BY type) AS total FROM m) SELECT type, id, total, total > 15 AS has_more FROM r WHERE rn > 5 AND rn <= 15""")
def pages_by_type(spark, sf):
    return listing.pages_by_type(media(spark, sf), "type", [F.desc("created_at"), F.desc("id")], 5, 10).select("type", "id", "total", "has_more")


#: Pages of one clustered copy: name, cursor, whether descending, rows.
CLUSTERED = [("first", None, True, 20), ("middle", (450, 60), True, 20), ("ascending", (450, 60), False, 20), ("into_none", (10, 1 << 40), True, 200), ("among_none", (None, 77), True, 9), ("end", (None, 1 << 40), False, 5)]


def clustered_sql(name: str, after: tuple | None, descending: bool, limit: int) -> str:
    way, sign = ("DESC", "<") if descending else ("ASC", ">")
    past = "true" if after is None else f"modified_at IS NULL AND id {sign} {after[1]}" if after[0] is None else f"(modified_at {sign} {after[0]} OR (modified_at = {after[0]} AND id {sign} {after[1]}) OR modified_at IS NULL)"
    rank = f"row_number() OVER (ORDER BY modified_at {way} NULLS LAST, id {way})"
    return f"SELECT '{name}' AS page, id, modified_at, n > {limit} AS has_more, CASE WHEN rn = {limit} AND n > {limit} THEN id END AS next_key FROM (SELECT id, modified_at, {rank} AS rn, count(*) OVER () AS n FROM m WHERE {past}) WHERE rn <= {limit}"


@query(" UNION ALL ".join(clustered_sql(*c) for c in CLUSTERED))
def clustered_pages(spark, sf):
    """Pages from the files they lie in, both ways, into the rows without a value, among them, and after the last."""
    path = scratch(spark, "pages")
    pages.write_clustered(media(spark, sf).select("id", "modified_at"), path, "modified_at", "id", file_rows=500)
    found = [pages.clustered_page(spark, path, "modified_at", "id", after, down, limit).select(F.lit(name).alias("page"), "id", "modified_at", "has_more", "next_key") for name, after, down, limit in CLUSTERED]
    return reduce(DataFrame.unionByName, found)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (date_trunc('second', o_orderdate), o_orderkey) < (TIMESTAMP '1997-01-01 00:00:00', 500) ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey DESC LIMIT 21")
def clustered_seconds(spark, sf):
    """The keyset page of orders, compared to the second, from a copy that is clustered by the second."""
    path = scratch(spark, "pages")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz").alias("second"))
    pages.write_clustered(o, path, "second", "o_orderkey", file_rows=2000)
    return pages.clustered_page(spark, path, "second", "o_orderkey", (datetime.datetime(1997, 1, 1), 500), limit=21).select("o_orderkey", "o_orderdate")


@query("""WITH r AS (SELECT type, id, created_at, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS rn FROM m) SELECT type, arg_max(created_at, rn) AS cursor_value, arg_max(id, rn) AS cursor_key, max(rn) >= 7 AS has_more FROM r WHERE rn <= 7 GROUP BY type""")
def grouped_cursors(spark, sf):
    from glimmer.operators import catalog_ops as C

    page = C.newest_per_group(media(spark, sf), "type", [F.desc("created_at"), F.desc("id")], 7)
    return listing.with_cursors(page, "type", "created_at", "id", 7)


@query("WITH a AS (SELECT id, score, created_at FROM m WHERE type = 'image' UNION ALL SELECT id, NULL, created_at FROM m WHERE type = 'video') SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, created_at DESC NULLS LAST, id) AS place FROM a")
def merged_stores(spark, sf):
    from pyspark.sql import Window

    from glimmer.operators import fusion

    m = media(spark, sf)
    out = fusion.merge_by_score(m.where("type = 'image'").select("id", "score", "created_at"), m.where("type = 'video'").select("id", F.lit(None).cast("double").alias("score"), "created_at"))
    return out.select("id", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id")).cast("long").alias("place"))


@query("SELECT DISTINCT path FROM m WHERE type <> 'video_segment'")
def distinct_paths(spark, sf):
    return media(spark, sf).where("type <> 'video_segment'").select("path").distinct()


@query("SELECT path, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, max(created_at) AS newest FROM m WHERE type <> 'video_segment' GROUP BY path HAVING count(*) > 1")
def repeated_paths(spark, sf):
    g = media(spark, sf).where("type <> 'video_segment'").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"), F.max("created_at").alias("newest"))
    return g.where("n > 1").select("path", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "newest")


# ---- jobs


@query("SELECT source_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("pending", "running", "completed", "failed", "scheduled", "delayed")) + " FROM j GROUP BY 1")
def seven_counts(spark, sf):
    return jobs.status_counts(job(spark, sf), ["source_id"], "status", ["pending", "running", "completed", "failed", "scheduled", "delayed"])


@query("SELECT id FROM j WHERE status = 'pending' AND retries < 3 ORDER BY priority DESC, created_at, id LIMIT 12")
def job_queue(spark, sf):
    return jobs.queue(job(spark, sf), 12).select("id")


@query("SELECT id FROM j WHERE status = 'pending' ORDER BY CASE WHEN pass = 1 THEN 0 ELSE 1 END, created_at DESC, id LIMIT 12")
def first_pass_queue(spark, sf):
    return jobs.first_pass_first(job(spark, sf), 12).select("id")


@query(f"SELECT id FROM j WHERE status = 'scheduled' AND scheduled_at <= {NOW} ORDER BY scheduled_at, CASE WHEN pass = 2 THEN 0 ELSE 1 END, id LIMIT 12")
def due_jobs(spark, sf):
    return jobs.due(job(spark, sf), F.lit(NOW), 12).select("id")


@query(f"SELECT id FROM j WHERE status = 'pending' OR (status = 'delayed' AND scheduled_at <= {NOW}) ORDER BY created_at, id LIMIT 1")
def pending_or_due(spark, sf):
    return jobs.pending_or_due(job(spark, sf), F.lit(NOW)).select("id")


STALLED = f"coalesce((status = 'pending' AND {NOW} - created_at > 300) OR (status = 'running' AND {NOW} - started_at > 1200) OR (status = 'scheduled' AND {NOW} - scheduled_at > 600), false)"


@query(f"SELECT id, CASE WHEN {STALLED} THEN 'pending' ELSE status END AS status, CASE WHEN NOT {STALLED} THEN started_at END AS started_at FROM j")
def reset_stalled(spark, sf):
    return jobs.reset_stalled(job(spark, sf), F.lit(NOW)).select("id", "status", "started_at")


@query(f"SELECT 'reset' AS kind, id FROM j WHERE {STALLED} UNION ALL SELECT 'enqueue', id FROM m WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.path = m.path AND j.status IN ('pending', 'running', 'completed'))")
def reconcile(spark, sf):
    return jobs.reconcile(job(spark, sf), media(spark, sf).select("id", "path"), F.lit(NOW))


@query("""WITH l AS (SELECT path, pass, CAST(min(id) AS VARCHAR) AS old FROM j WHERE status IN ('pending', 'running') GROUP BY 1, 2), w AS (SELECT DISTINCT path, pass FROM m)
    SELECT w.path, w.pass, coalesce(old, substr(sha256(w.path || '|' || w.pass), 1, 32)) AS id, old IS NULL AS created FROM w LEFT JOIN l ON l.path = w.path AND l.pass = w.pass""")
def create_jobs(spark, sf):
    return jobs.create_jobs(media(spark, sf), job(spark, sf))


@query(f"""SELECT path, p.pass, p.threshold, round({NOW} + delay * (1 - 0.2e0 + 2 * 0.2e0 * {unit_sql("path || '|' || p.pass")}), 6) AS scheduled_at FROM j, (VALUES (2, 0.6e0, 300), (3, 0.4e0, 1800)) p(pass, threshold, delay) WHERE status = 'completed' AND j.pass = 1""")
def schedule_passes(spark, sf):
    return jobs.schedule_passes(job(spark, sf), [(1, 0.8, 0), (2, 0.6, 300), (3, 0.4, 1800)], F.lit(NOW)).select("path", "pass", "threshold", r6("scheduled_at").alias("scheduled_at"))


@query("SELECT id, coalesce(status = 'completed' AND progress >= 60 AND retries <= 2 * 10, false) AS runs FROM j")
def run_gate(spark, sf):
    return job(spark, sf).select("id", jobs.gate(F.col("status"), F.col("progress"), F.col("retries")).alias("runs"))


@query(f"WITH r AS (SELECT id, mode, row_number() OVER (PARTITION BY mode ORDER BY created_at, id) AS rn FROM j WHERE status = 'pending' AND (mode = 'coarse' OR created_at <= {NOW} - 900)) SELECT id, mode FROM r WHERE rn <= CASE WHEN mode = 'coarse' THEN 5 ELSE 3 END")
def coarse_and_fine(spark, sf):
    return jobs.coarse_and_fine(job(spark, sf), F.lit(NOW)).select("id", "mode")


@query("""WITH g AS (SELECT source_id, count(*) AS total, count(*) FILTER (status = 'completed') AS c, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'pending') AS p FROM j GROUP BY 1)
    SELECT 'scan' AS kind, CAST(id AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS completed, CAST(NULL AS BIGINT) AS failed, priority AS progress FROM m WHERE status = 'running'
    UNION ALL SELECT 'source', CAST(source_id AS VARCHAR), total, c, f, CAST(floor(100.0 * c / total) AS BIGINT) FROM g WHERE p > 0 OR c + f < total""")
def active_jobs(spark, sf):
    return jobs.active_view(media(spark, sf).withColumn("progress", F.col("priority")), job(spark, sf))


@query("SELECT path, status FROM (SELECT path, status, row_number() OVER (PARTITION BY path ORDER BY k, status) AS rn FROM (SELECT path, status, 0 AS k FROM m UNION ALL SELECT path, status, 1 FROM j)) WHERE rn = 1")
def job_union(spark, sf):
    return jobs.first_of("path", media(spark, sf).select("path", "status"), job(spark, sf).select("path", "status"))


@query("""SELECT id, CASE WHEN status IN ('scheduled', 'pending') THEN 'Queued' WHEN status = 'running' AND coalesce(message, '') <> '' THEN message WHEN status = 'running' THEN CASE WHEN progress < 30 THEN 'Extracting Video Segments' WHEN progress < 70 THEN 'Generating Transcriptions' ELSE 'Creating Keyframes' END WHEN status = 'completed' THEN 'Video Processing Complete' END AS title,
    CASE WHEN status IN ('scheduled', 'pending') THEN 'video_queue' WHEN status = 'running' AND coalesce(message, '') <> '' THEN CASE WHEN mode = 'coarse' THEN 'video_segmentation' ELSE 'video_keyframes' END WHEN status = 'running' THEN CASE WHEN progress < 30 THEN 'video_segmentation' WHEN progress < 70 THEN 'video_transcription' ELSE 'video_keyframes' END WHEN status = 'completed' THEN 'video_complete' END AS operation,
    CASE WHEN status IN ('scheduled', 'pending') THEN 'Queued for video processing: ' WHEN status = 'running' AND coalesce(message, '') <> '' THEN 'Processing ' WHEN status = 'running' THEN CASE WHEN progress < 30 THEN 'Extracting segments from ' WHEN progress < 70 THEN 'Creating transcriptions for ' ELSE 'Generating keyframes for ' END WHEN status = 'completed' THEN 'Completed processing ' END || split_part(path, '/', -1) AS description FROM j""")
def job_titles(spark, sf):
    phase = F.when(F.col("mode") == "coarse", "phase0").otherwise("phase1")
    return job(spark, sf).select("id", jobs.job_title(F.col("status"), F.col("progress"), F.col("message"), F.col("path"), phase).alias("t")).select("id", "t.title", "t.operation", "t.description")


@query("""WITH f AS (SELECT DISTINCT path FROM j WHERE pass = 1) SELECT 'item' AS kind, CAST(id AS VARCHAR) AS id FROM m WHERE path NOT IN (SELECT path FROM f)
    UNION ALL SELECT 'source', source_id FROM (VALUES ('s1'), ('s3'), ('gone')) x(source_id) WHERE source_id NOT IN (SELECT source_id FROM m WHERE path IN (SELECT path FROM f) AND source_id IS NOT NULL)""")
def orphan_clean_up(spark, sf):
    sources = spark.createDataFrame([("s1",), ("s3",), ("gone",)], "source_id string")
    return jobs.orphans(media(spark, sf), job(spark, sf).where("pass = 1"), sources)


@query("SELECT id, created_at FROM j WHERE pass = 2 ORDER BY created_at DESC, id")
def refinement_metrics(spark, sf):
    return jobs.phase_metrics(job(spark, sf), number=2).select("id", "created_at")


# ---- search


def held(spark, sf):
    return search.postings(spark, f"{sf}/documents", table(spark, sf, "documents"))


def bm_sql(terms: list[str], every: bool = False) -> str:
    """BM25 in SQL, by phrase; a closing * stands for a prefix."""
    values = ", ".join(f"('{t}')" for t in terms)
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS words FROM documents),
        c AS (SELECT doc_id, len(words) AS dl, t.p, len(list_filter(words, lambda x: CASE WHEN ends_with(t.p, '*') THEN starts_with(x, t.p[:-2]) ELSE x = t.p END)) AS f FROM w, (VALUES {values}) t(p)),
        n AS (SELECT p, count(*) FILTER (f > 0) AS n FROM c GROUP BY p), g AS (SELECT count(*) AS nd, avg(len(words)) AS avgdl FROM w),
        b AS (SELECT doc_id, -sum(CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - n + 0.5) / (n + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM c JOIN n USING (p), g GROUP BY doc_id HAVING {f"count(*) FILTER (f > 0) = {len(terms)}" if every else "sum(f) > 0"})"""


@query(bm_sql(["thing", "under", "the"], True) + " SELECT doc_id, round(bm25, 6) AS bm25, (SELECT count(*) FROM b) AS total FROM b ORDER BY round(bm25, 6), doc_id LIMIT 20")
def fts_all_terms(spark, sf):
    found = search.ranked(spark, held(spark, sf), ["thing", "under", "the"], all_terms=True).select("doc_id", r6("bm25").alias("bm25"))
    return search.top(found, 20).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


@query(bm_sql(["thi", "thi*", "und", "und*"]) + " SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY 2, 1 LIMIT 20")
def fts_prefix(spark, sf):
    return search.top(search.ranked(spark, held(spark, sf), search.phrases(["thi", "und"], True)).select("doc_id", r6("bm25").alias("bm25")), 20)


@query(bm_sql(["thing"]) + ", h AS (SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY 2, 1 LIMIT 25) SELECT h.doc_id, h.bm25, lang, source, n_chars FROM h JOIN documents USING (doc_id)")
def fts_with_metadata(spark, sf):
    page = search.ranked_top(spark, held(spark, sf), ["thing"], 25)
    return search.with_metadata(page, table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding FROM q)::DOUBLE[]) AS d FROM embeddings ORDER BY d, vec_id LIMIT 50)
    SELECT vec_id AS id, round(d, 6) AS distance, name, path, type FROM h JOIN m ON m.id = h.vec_id""")
def knn_with_metadata(spark, sf):
    from glimmer.plans.registry import neighbours

    page = neighbours(spark, sf, 50).select(F.col("vec_id").alias("id"), r6("distance").alias("distance"))
    return search.with_metadata(page, media(spark, sf).select("id", "name", "path", "type"), "id")


@query(bm_sql(["thing"]) + ", h AS (SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY 2, 1 LIMIT 40) SELECT s.id, h.bm25, m.path FROM h JOIN s ON s.id = h.doc_id JOIN m ON m.id = s.video")
def fts_segments_files(spark, sf):
    page = search.ranked_top(spark, held(spark, sf), ["thing"], 40).withColumnRenamed("doc_id", "id")
    found = search.with_metadata(page, segs(spark, sf).select("id", F.col("video").alias("file")), "id")
    return media(spark, sf).select(F.col("id").alias("file"), "path").join(F.broadcast(found), "file").select("id", "bm25", "path")


@query(bm_sql(["mountain", "mountain*", "thing", "thing*"]) + " SELECT doc_id, lang, 0.5::DOUBLE AS score FROM b JOIN documents USING (doc_id) ORDER BY doc_id LIMIT 20")
def fast_text_search(spark, sf):
    found = search.matching(spark, held(spark, sf), search.prepared("The mountains, and things!"))
    return search.with_metadata(found.orderBy("doc_id").limit(20), table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("score", F.lit(0.5))


@query(bm_sql(["er", "tion", "tion*", "thing", "thing*"]) + ", r AS (SELECT id, type, path, row_number() OVER (PARTITION BY type ORDER BY id) AS place FROM m WHERE type IN ('image', 'video') AND id IN (SELECT doc_id FROM b)) SELECT id, type, path, place, 0.5::DOUBLE AS score FROM r WHERE place <= 15")
def fast_text_pages(spark, sf):
    m = media(spark, sf).select("id", "type", "path")
    return search.fast_search(spark, held(spark, sf), m, "Er... and the TION of things?", ["image", "video"], 15)


@query("SELECT DISTINCT lang, 'other' AS type FROM documents")
def folder_scan(spark, sf):
    """Documents written to a folder for each language, found by listing the tree in tasks."""
    path = scratch(spark, "tree")
    table(spark, sf, "documents").write.partitionBy("lang").parquet(path)
    found = folders.read_folder(spark, path, extensions="parquet").where("length > 0")
    return found.select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "type").distinct()


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, CASE doc_id % 3 WHEN 0 THEN 'spatial' WHEN 1 THEN 'audio' ELSE 'action' END AS kind, CASE doc_id % 4 WHEN 0 THEN '["thing","car"]' WHEN 1 THEN '[]' WHEN 2 THEN 'no json' END AS el FROM documents),
    b AS (SELECT doc_id, kind, (contains(t, 'thing')::INT + contains(t, 'under')::INT) * 0.1e0 AS n, contains(t, 'walking')::INT * 0.1e0 AS w, CASE WHEN el LIKE '[%' AND el <> '[]' THEN 0.05e0 ELSE 0 END AS e, length(t) AS len, el FROM d)
    SELECT doc_id, round(least(0.3e0, n * CASE WHEN kind = 'spatial' THEN 1.5e0 ELSE 1 END), 6) AS spatial, round(least(0.3e0, w * CASE WHEN kind = 'action' THEN 1.5e0 ELSE 1 END), 6) AS temporal, round(least(0.3e0, n * CASE WHEN kind = 'audio' THEN 1.5e0 ELSE 1 END), 6) AS audio,
    round(e::DOUBLE, 6) AS element, round(CASE WHEN len > 10 THEN 0.1e0 ELSE 0 END + e, 6) AS quality FROM b""")
def score_boosts(spark, sf):
    t, kind = F.col("text"), F.when(F.col("doc_id") % 3 == 0, "spatial").when(F.col("doc_id") % 3 == 1, "audio").otherwise("action")
    el = F.when(F.col("doc_id") % 4 == 0, '["thing","car"]').when(F.col("doc_id") % 4 == 1, "[]").when(F.col("doc_id") % 4 == 2, "no json")
    q, words = F.lit("A thing walking"), F.array(F.lit("Thing"), F.lit("under"))
    boosts = {"spatial": search.spatial_boost(t, words, kind), "temporal": search.temporal_boost(q, t, kind), "audio": search.audio_boost(t, words, kind), "element": search.element_boost(q, el), "quality": search.quality_bonus(t, t, el)}
    return table(spark, sf, "documents").select("doc_id", *[r6(c).alias(n) for n, c in boosts.items()])


@query("""SELECT d.doc_id, round(CASE WHEN quality IS NULL THEN 0.5e0 ELSE least(1, CASE WHEN quality = 0 THEN 0.5e0 ELSE quality * 0.6e0 END + least(0.3e0, (contains(lower(coalesce(text, '')), 'thing')::INT + contains(lower(coalesce(text, '')), 'under')::INT) * 0.1e0 * 1.5e0) + CASE WHEN length(coalesce(text, '')) > 10 THEN 0.05e0 ELSE 0 END) END, 6) AS score
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def boosted_scores(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    boosts = [search.spatial_boost(F.col("text"), F.array(F.lit("thing"), F.lit("under")), F.lit("mixed")), search.quality_bonus(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"))]
    return d.select("doc_id", r6(search.adaptive(F.col("quality") * 0.6, boosts, F.col("quality").isNotNull())).alias("score"))


@query("""SELECT doc_id, round(least(1, contains(t, 'the thing')::INT * 0.8e0 + contains(t, 'the')::INT * 0.3e0 + contains(t, 'thing')::INT * 0.3e0 + contains(s, 'the thing')::INT * 0.6e0 + contains(s, 'the')::INT * 0.2e0 + contains(s, 'thing')::INT * 0.2e0), 6) AS relevance FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s FROM documents)""")
def player_relevance(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(search.player_relevance("The thing", F.col("text"), F.col("source"), F.lit(""))).alias("relevance"))


@query("""WITH c AS (SELECT doc_id, lower(coalesce(text, '')) AS c, quality * 0.9e0 AS s FROM documents JOIN labels USING (doc_id)), b AS (SELECT *, least(1, contains(c, 'person')::INT * 0.3e0 + (contains(c, 'human')::INT + contains(c, 'individual')::INT + contains(c, 'people')::INT + contains(c, 'figure')::INT) * 0.4e0) AS boost FROM c)
    SELECT doc_id, round(greatest(0, s * (1 + boost) * (1 - CASE WHEN """ + " OR ".join(f"contains(c, '{w}')" for w in search.FAR_OFF) + " THEN 0.7e0 WHEN " + " OR ".join(f"contains(c, '{w}')" for w in search.OFF) + " THEN 0.3e0 ELSE 0 END) * CASE WHEN " + " OR ".join(f"contains(c, '{w}')" for w in search.HUMAN_CONTEXT) + " THEN 1 ELSE 0.6e0 END), 6) AS score FROM b")
def cosine_rerank(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", r6(search.reranked(F.col("quality") * 0.9, F.col("text"), "person")).alias("score"))


@query("SELECT id, split_part(path, '#t=', 1) AS base, CASE WHEN contains(path, '#t=') THEN CAST(regexp_extract(path, '#t=([^,]+),', 1) AS DOUBLE) END AS start, CASE WHEN contains(path, '#t=') THEN CAST(regexp_extract(path, '#t=[^,]+,([^&]+)', 1) AS DOUBLE) END AS \"end\" FROM m")
def path_fragments(spark, sf):
    return media(spark, sf).select("id", search.fragment(F.col("path")).alias("f")).select("id", "f.*")


@query("""WITH i AS (SELECT id, name, -score AS s, split_part(path, '#t=', 1) AS base, contains(path, '#t=') AS cut, CASE WHEN contains(path, '#t=') THEN CAST(floor(CAST(regexp_extract(path, '#t=([^,]+),', 1) AS DOUBLE)) AS BIGINT) END AS a, CASE WHEN contains(path, '#t=') THEN CAST(regexp_extract(path, '#t=[^,]+,([^&]+)', 1) AS BIGINT) END AS b FROM m WHERE type IN ('video', 'video_segment') AND id % 3 > 0),
    k AS (SELECT path AS base, min(id) AS id, arg_min(name, id) AS name FROM m WHERE type = 'video' GROUP BY 1),
    g AS (SELECT base, arg_min(id, (s IS NULL, coalesce(s, 0), id)) FILTER (NOT cut) AS pid, arg_min(name, (s IS NULL, coalesce(s, 0), id)) FILTER (NOT cut) AS pname, arg_min(id, (s IS NULL, coalesce(s, 0), id)) FILTER (cut) AS sid, arg_min(name, (s IS NULL, coalesce(s, 0), id)) FILTER (cut) AS sname, count(*) FILTER (cut) AS n, coalesce(string_agg(a || '-' || b, ', ' ORDER BY id) FILTER (cut), '') AS ranges FROM i GROUP BY base)
    SELECT g.base, coalesce(pid, k.id, sid) AS id, CASE WHEN coalesce(pid, k.id) IS NULL THEN sname WHEN n > 0 THEN coalesce(pname, k.name) || ' (' || n || ' segments match)' ELSE coalesce(pname, k.name) END AS name, n AS matching_segments, ranges FROM g LEFT JOIN k ON k.base = g.base""")
def collapsed_videos(spark, sf):
    m = media(spark, sf)
    return search.collapse_videos(m.where("type IN ('video', 'video_segment') AND id % 3 > 0"), m)


@query("SELECT video, max(score) AS score, arg_min(id, (-score, id)) AS best, count(*) AS matches, string_agg(CAST(floor(start) AS BIGINT) || 's-' || CAST(floor(\"end\") AS BIGINT) || 's', ', ' ORDER BY -score, id) AS ranges FROM s GROUP BY 1")
def best_segments(spark, sf):
    return search.best_segment(segs(spark, sf), "video", "id", "score", "start", "end")


# ---- query understanding


def any_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


FAM = ", ".join(f"{any_sql(w)} AS h_{k}" for k, w in understanding.FAMILIES.items())
ASKS = "SELECT item_id, text, lower(coalesce(text, '')) || CASE item_id % 6 WHEN 0 THEN ' first 5 minutes' WHEN 1 THEN ' after 2 hr' WHEN 2 THEN ' a 3 min clip' WHEN 3 THEN ' start' WHEN 4 THEN ' the end' ELSE '' END AS q FROM benchmark"
TAILS = {0: " first 5 minutes", 1: " after 2 hr", 2: " a 3 min clip", 3: " start", 4: " the end"}
MARK = """CASE WHEN regexp_extract(q, '(\\d+)\\s*(minute|min|second|sec|hour|hr)s?', 1) <> '' THEN CASE WHEN contains(q, 'first') OR contains(q, 'beginning') THEN '0-' || sec WHEN contains(q, 'after') THEN sec || '-end' END WHEN contains(q, 'beginning') OR contains(q, 'start') THEN '0-60' WHEN contains(q, 'end') THEN 'last-60' END"""
SEC = """TRY_CAST(regexp_extract(q, '(\\d+)\\s*(minute|min|second|sec|hour|hr)s?', 1) AS BIGINT) * CASE WHEN regexp_extract(q, '(\\d+)\\s*(minute|min|second|sec|hour|hr)s?', 2) LIKE 'min%' THEN 60 WHEN regexp_extract(q, '(\\d+)\\s*(minute|min|second|sec|hour|hr)s?', 2) LIKE 'h%' THEN 3600 ELSE 1 END AS sec"""


def asks(spark, sf):
    tail = F.lit("")
    for k, t in TAILS.items():
        tail = F.when(F.col("item_id") % 6 == k, t).otherwise(tail)
    return table(spark, sf, "benchmark").select("item_id", "text", F.concat(F.lower(F.coalesce("text", F.lit(""))), tail).alias("q"))


@query(f"""WITH a AS ({ASKS}), f AS (SELECT *, {FAM}, {SEC} FROM a), t AS (SELECT *, CASE WHEN h_spatial::INT + h_temporal::INT + h_audio::INT + h_action::INT <> 1 THEN 'mixed' WHEN h_spatial THEN 'spatial' WHEN h_temporal THEN 'temporal' WHEN h_audio THEN 'audio' ELSE 'action' END AS kind, {MARK} AS marker FROM f)
    SELECT item_id, kind, array_to_string(list_filter([CASE WHEN h_spatial THEN 'visual' END, CASE WHEN h_temporal THEN 'time' END, CASE WHEN h_audio THEN 'sound' END, CASE WHEN h_action THEN 'activity' END], lambda x: x IS NOT NULL), ',') AS subtypes, marker,
    CASE WHEN kind = 'mixed' AND {any_sql([*understanding.TIME_WORDS, "minute", "second"])} AND NOT {any_sql(understanding.AUDIO_WORDS)} THEN 'temporal' ELSE kind END AS promoted FROM t""")
def query_classes(spark, sf):
    q = F.col("q")
    none = F.array().cast("array<string>")
    c = asks(spark, sf).select("item_id", "q", understanding.classify(q).alias("c"), understanding.time_marker(q).alias("marker"))
    return c.select("item_id", F.col("c.type").alias("kind"), F.array_join("c.subtypes", ",").alias("subtypes"), "marker", understanding.promoted(q, F.col("c.type"), none, none).alias("promoted"))


@query(f"""WITH a AS ({ASKS}), t AS (SELECT *, {MARK} AS marker FROM (SELECT *, {SEC} FROM a))
    SELECT item_id, CASE WHEN {any_sql([*understanding.TIME_WORDS, "minute", "second", "at"])} AND (marker LIKE '0-%' OR marker LIKE '%-end' OR marker = 'last-60') THEN CASE WHEN marker LIKE '%-end' THEN CAST(split_part(marker, '-', 1) AS INT) ELSE 0 END END AS start,
    CASE WHEN {any_sql([*understanding.TIME_WORDS, "minute", "second", "at"])} AND marker NOT LIKE '%-end' THEN CAST(split_part(marker, '-', 2) AS INT) END AS "end" FROM t""")
def time_ranges(spark, sf):
    q = F.col("q")
    return asks(spark, sf).select("item_id", understanding.time_range(q, F.lit("temporal"), understanding.time_marker(q)).alias("r")).select("item_id", "r.start", "r.end")


def words_sql(least: int, stops: list[str]) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^0-9A-Za-z_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= {least} AND w NOT IN ({', '.join(repr(x) for x in stops)}))"


@query(f"SELECT item_id, array_to_string(list_slice({words_sql(4, understanding.KEYWORD_STOPS)}, 1, 3), ' ') AS keywords, array_to_string({words_sql(4, understanding.ENTITY_STOPS)}, ' ') AS entities, array_to_string(list_slice({words_sql(3, understanding.FALLBACK_STOPS)}, 1, 3), ' ') AS fallback, text AS cleaned FROM benchmark")
def keyword_fallbacks(spark, sf):
    t = F.col("text")
    fall = understanding.fallback_query(F.concat(F.lit("Show me  "), t))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(understanding.keywords(t), " ").alias("keywords"), F.array_join(understanding.entities(t), " ").alias("entities"), F.array_join(understanding.fallback_query(t)["keywords"], " ").alias("fallback"), fall["cleaned"].alias("cleaned"))


@query(f"""WITH a AS ({ASKS}), w AS (SELECT *, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS w FROM a)
    SELECT item_id, array_to_string(list_filter(w, lambda x: x NOT IN ({", ".join(repr(x) for x in understanding.TIME_WORDS)})), ' ') AS audio, CASE WHEN {any_sql([*understanding.TIME_WORDS, "minute", "second"])} AND NOT {any_sql(understanding.AUDIO_WORDS)} AND item_id % 2 = 0 THEN 'temporal' ELSE 'mixed' END AS promoted,
    array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[^0-9A-Za-z_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''), ' ') AS cleaned FROM w""")
def cleaned_queries(spark, sf):
    """Elements of sound without words of time, mixed queries with and without spatial elements, words without signs."""
    q = F.col("q")
    words = F.filter(F.split(q, r"\s+"), lambda x: x != "")
    none = F.array().cast("array<string>")
    spatial = F.when(F.col("item_id") % 2 == 1, F.slice(words, 1, 1)).otherwise(none)
    kind = understanding.promoted(q, F.lit("mixed"), spatial, none)
    return asks(spark, sf).select("item_id", F.array_join(understanding.audio_elements(words), " ").alias("audio"), kind.alias("promoted"), F.array_join(text_ops.clean_query(F.col("text")), " ").alias("cleaned"))


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
    k AS (SELECT item_id, w, list_transform(list_concat(list_slice(w, 3, 6), list_transform(list_slice(w, 5, 9), lambda x: upper(x))), lambda x: lower(trim(x))) AS k FROM w),
    q AS (SELECT item_id, array_to_string(list_filter([w[1], CASE WHEN item_id % 3 > 0 THEN w[3] END, w[2], CASE WHEN item_id % 3 < 2 AND len(k) > 0 THEN array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' ') END], lambda x: x IS NOT NULL), '|') AS query FROM k),
    p AS (SELECT *, string_split(query, '|') AS p FROM q)
    SELECT item_id, query, coalesce(nullif(trim(p[1]), ''), trim(query)) AS cleaned, coalesce(nullif(trim(p[2]), ''), trim(query)) AS step_back, coalesce(nullif(trim(p[3]), ''), trim(query)) AS fts FROM p""")
def query_strings(spark, sf):
    """Lists of the items' own words: one or two parts, with and without a step back and keywords."""
    w, none = F.split("text", " "), F.array().cast("array<string>")
    words = understanding.keyword_union(F.slice(w, 3, 4), F.transform(F.slice(w, 5, 5), understanding.upper_letters))
    back = F.when(F.col("item_id") % 3 > 0, F.slice(w, 3, 1)).otherwise(none)
    q = understanding.query_string(F.slice(w, 1, 2), back, F.when(F.col("item_id") % 3 < 2, words).otherwise(none))
    return table(spark, sf, "benchmark").where("text IS NOT NULL").select("item_id", q.alias("query"), understanding.parse_query(q).alias("p")).select("item_id", "query", "p.*")


@query("SELECT item_id, CASE WHEN length(t) > 150 OR t = '' THEN text ELSE t END AS line FROM (SELECT item_id, text, trim(replace(regexp_replace(text, '^\\d+\\.\\s*', '', 'gm'), chr(10), ' ')) AS t FROM benchmark)")
def model_lines(spark, sf):
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", understanding.clean_output(F.concat(F.lit('Keywords: "'), t, F.lit('"')), t).alias("line"))


# ---- intervals and keyframes


@query("""WITH n AS (SELECT * FROM s WHERE id % 2 = 0), o AS (SELECT * FROM s WHERE id % 2 = 1),
    p AS (SELECT n.id, o.id AS o_id, (least(n."end", o."end") - greatest(n.start, o.start)) / least(n."end" - n.start, o."end" - o.start) AS share FROM n JOIN o ON n.video = o.video AND n.start < o."end" AND n."end" > o.start),
    k AS (SELECT id FROM p GROUP BY id HAVING max(share) < 0.8), g AS (SELECT o_id, arg_min(id, (-share, id)) AS by_id FROM p WHERE share > 0.5 AND id IN (SELECT id FROM k) GROUP BY o_id)
    SELECT o.id, by_id AS superseded_by, CASE WHEN by_id IS NOT NULL THEN 50 ELSE 200 + greatest(0, 20 - (o."end" - o.start)) END AS priority FROM o LEFT JOIN g ON g.o_id = o.id""")
def superseded_segments(spark, sf):
    s = segs(spark, sf)
    old = s.where("id % 2 = 1")
    _, gone = intervals.compare_incremental(s.where("id % 2 = 0"), old.select("video", F.col("id").alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end")), "video")
    rows = old.select("id", F.lit(None).cast("long").alias("superseded_by"), intervals.priority(F.lit(2), F.col("end") - F.col("start")).alias("priority"))
    return intervals.mark_superseded(rows, gone)


@query("""WITH r AS (SELECT *, lag(type) OVER w AS pt, lag(t) OVER w AS p FROM v WINDOW w AS (PARTITION BY video ORDER BY t, id)) SELECT video, p AS start, t AS "end" FROM r WHERE type = 'I' AND pt = 'I' AND t - p < 2""")
def close_i_frames(spark, sf):
    return intervals.close_frames(frames(spark, sf), "video")


@query("""WITH r AS (SELECT video, t AS start, lead(t, 9) OVER w AS "end", avg(CASE WHEN type = 'P' THEN 1e0 ELSE 0 END) OVER (PARTITION BY video ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS i, lead(id, 10) OVER w AS nx FROM v WINDOW w AS (PARTITION BY video ORDER BY t, id))
    SELECT video, start, "end", round(i, 6) AS intensity FROM r WHERE nx IS NOT NULL AND i > 0.7""")
def motion_windows(spark, sf):
    return intervals.motion_windows(frames(spark, sf), "video").select("video", "start", "end", r6("intensity").alias("intensity"))


@query("""WITH l AS (SELECT *, lag(start) OVER w AS a, lag("end") OVER w AS b FROM s WINDOW w AS (PARTITION BY video ORDER BY start, "end", id)),
    f AS (SELECT *, CASE WHEN a IS NOT NULL AND ((least("end", b) > greatest(start, a) AND (least("end", b) - greatest(start, a)) / (greatest("end", b) - least(start, a)) > 0.3) OR (start - b >= 0 AND start - b <= 5)) THEN 0 ELSE 1 END AS n FROM l),
    i AS (SELECT *, sum(n) OVER (PARTITION BY video ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT video, min(start) AS start, max("end") AS "end", round(avg(score), 6) AS score, coalesce(string_agg(text, ' ' ORDER BY start, "end", id) FILTER (text <> ''), '') AS text, arg_min(thumbnail, (-score, start, id)) AS thumbnail FROM i GROUP BY video, island HAVING max("end") - min(start) >= 2""")
def merged_texts(spark, sf):
    return intervals.merged_texts(segs(spark, sf), "video").select("video", "start", "end", r6("score").alias("score"), "text", "thumbnail")


@query("SELECT DISTINCT video, t FROM v WHERE scene > 0.7 * 0.6e0")
def scene_cuts(spark, sf):
    return K.scene_cuts(frames(spark, sf), "video", 0.6, ["basic_scene", "motion_analysis", "edge_detection"])


@query(f"""SELECT id, round(greatest(0, least(size % 200, k * 15e0 + ({unit_sql("id || '|' || k")} * 2 - 1) * 15 * 0.1e0)), 6) AS t FROM m, range(1, 100) r(k) WHERE k * 15 < size % 200""")
def fallback_cuts(spark, sf):
    v = media(spark, sf).select("id", (F.col("size") % 200).cast("double").alias("duration"))
    return K.fallback_cuts(v, "id", "duration").select("id", r6("t").alias("t"))


@query("""WITH RECURSIVE x AS (SELECT video, t, motion * 0.3e0 + histogram * 0.4e0 + complexity * 0.3e0 AS sc, complexity FROM v), y AS (SELECT *, CASE WHEN complexity > 0.7 THEN sc * 1.5e0 ELSE sc END AS b FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, sc, b) AS rn FROM y),
    w AS (SELECT video, rn, t, t AS last, 1 AS n, false AS done, true AS kept FROM z WHERE rn = 1
        UNION ALL SELECT z.video, z.rn, z.t, CASE WHEN k THEN z.t ELSE w.last END, w.n + k::INT, w.done OR (z.t - w.last < 8 AND z.t - w.last >= 0.5 AND w.n + k::INT >= 20), k
        FROM w JOIN z ON z.video = w.video AND z.rn = w.rn + 1, LATERAL (SELECT NOT w.done AND (z.t - w.last >= 8 OR (z.t - w.last >= 0.5 AND z.b >= 0.2)) AS k) q)
    SELECT video, t FROM w WHERE kept""")
def greedy_keyframes(spark, sf):
    return K.greedy_keyframes(frames(spark, sf), "video")


@query("""SELECT id, CASE WHEN motion > 0.7 THEN 0.3e0 WHEN motion > 0.4 THEN 0.4e0 WHEN motion > 0.2 THEN 0.5e0 ELSE 0.6e0 END AS cut, id % 3 = 0 AND motion > 0.2 AS fallback,
    round(greatest(0.2e0, least(0.7e0, CASE WHEN t / 10 > 2 THEN 0.3e0 ELSE 0.5e0 END - motion * 0.2e0 + CASE WHEN complexity > 0.7 THEN 0.1e0 ELSE -0.1e0 END)), 6) AS scene, kind, greatest(1, least(least(5, greatest(1, CAST(ceil(t / 3) AS INT))), CASE kind WHEN 'static' THEN 1 WHEN 'dialogue' THEN least(2, CAST(ceil(t / 8) AS INT)) WHEN 'action' THEN least(5, CAST(ceil(t / 3) AS INT)) ELSE least(3, CAST(ceil(t / 4) AS INT)) END)) AS target
    FROM (SELECT *, CASE WHEN id % 7 = 0 THEN 'transition' WHEN motion < 0.1 THEN 'static' WHEN motion > 0.4 AND complexity > 0.3 THEN 'action' ELSE 'dialogue' END AS kind FROM v)""")
def segment_plans(spark, sf):
    m, c, t = F.col("motion"), F.col("complexity"), F.col("t")
    kind = K.segment_kind(F.col("id") % 7 == 0, m, c)
    th = K.thresholds(m, c, t / 10, t)
    return frames(spark, sf).select("id", K.adaptive_threshold(m).alias("cut"), K.needs_fallback(m, F.col("id") % 3).alias("fallback"), r6(th["scene"]).alias("scene"), kind.alias("kind"), K.target_count(kind, t, th["most"]).alias("target"))


@query(f"""WITH p AS (SELECT video, list_filter(list(t ORDER BY t) FILTER (motion > 0.9), lambda x: x >= 10 AND x <= 90) AS peaks FROM v GROUP BY video),
    e AS (SELECT video, CASE WHEN len(peaks) > 0 THEN list_slice(peaks, 1, 4) ELSE list_transform([1, 2, 3, 4], lambda i: greatest(10, least(90, 10 + 16e0 * i + ({unit_sql("video || '|' || i")} - 0.5e0) * 1))) END AS times FROM p)
    SELECT video, n - 1 AS n, round(times[n], 6) AS t FROM e, range(1, 5) r(n) WHERE n <= len(times)""")
def weighted_times(spark, sf):
    """The peaks of a video, or even places where it has none."""
    g = frames(spark, sf).groupBy("video").agg(F.array_sort(F.collect_list(F.when(F.col("motion") > 0.9, F.col("t")))).alias("peaks"))
    t = K.weighted_times(F.col("peaks"), F.lit(10.0), F.lit(90.0), 4, F.col("video"))
    return g.select("video", F.posexplode(t).alias("n", "t")).select("video", F.col("n").cast("long").alias("n"), r6("t").alias("t"))


@query("""SELECT video, round(coalesce(avg(motion) FILTER (type = 'I'), 0), 6) AS motion, round(coalesce(avg(motion) FILTER (type = 'P'), 0), 6) AS complexity, round(count(*) / 2e0, 6) AS cuts_per_minute FROM v GROUP BY video""")
def coarse_stats(spark, sf):
    r = frames(spark, sf).select("video", F.when(F.col("type") == "I", "motion_spike").otherwise("histogram_shift").alias("type"), F.col("motion").alias("intensity"), F.lit(2.0).alias("minutes"))
    return K.coarse_stats(r, "video", "minutes").select("video", *[r6(c).alias(c) for c in ("motion", "complexity", "cuts_per_minute")])


@query("""WITH c AS (SELECT video, id AS sample, sum(CASE tech WHEN 'motion' THEN x * 0.6e0 WHEN 'edge' THEN x * 0.4e0 ELSE 0 END) AS score FROM (SELECT video, id, 'motion' AS tech, motion AS x FROM v UNION ALL SELECT video, id, 'edge', scene FROM v) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, sample) AS rn, count(*) OVER (PARTITION BY video) AS n, greatest(1, ceil(40e0 / 3)) AS least_n FROM c)
    SELECT video, sample, round(score, 6) AS score FROM r WHERE rn <= least(20, CASE WHEN greatest(1, ceil(n * 0.25e0)) >= least_n THEN greatest(1, ceil(n * 0.25e0)) WHEN greatest(1, ceil(n * 0.4e0)) >= least_n THEN greatest(1, ceil(n * 0.4e0)) WHEN n >= least_n THEN least_n ELSE n END)""")
def progressive_selection(spark, sf):
    f = frames(spark, sf)
    rows = f.select("video", F.col("id").alias("sample"), F.lit("motion").alias("technique"), F.col("motion").alias("score")).unionByName(f.select("video", F.col("id").alias("sample"), F.lit("edge").alias("technique"), F.col("scene").alias("score")))
    scored = K.weighted_scores(rows, "video", {"motion": 0.6, "edge": 0.4}).withColumn("duration", F.lit(40.0))
    return K.top_share(scored, "video", "duration", "background").select("video", "sample", r6("score").alias("score"))


@query("""WITH l AS (SELECT video, list(motion ORDER BY motion DESC) AS x FROM v GROUP BY video) SELECT video, round(x[least(len(x), CAST(floor(len(x) * 0.2e0) AS INT) + 1)], 6) AS p80, round(x[least(len(x), CAST(floor(len(x) * 0.3e0) AS INT) + 1)], 6) AS p70 FROM l""")
def percentile_cuts(spark, sf):
    return K.cut_offs(frames(spark, sf), "video", "motion").select("video", r6("p80").alias("p80"), r6("p70").alias("p70"))


@query("""SELECT page_id, lower(lpad(printf('%x', list_sum(list_transform(range(64), lambda i: CASE WHEN p[i + 1] > mean THEN (1::HUGEINT << (63 - i)) ELSE 0 END))::UBIGINT), 16, '0')) AS p_hash FROM (SELECT *, list_sum(p) / 64e0 AS mean FROM (SELECT page_id, list_transform(range(64), lambda i: ascii(substr(md5(url) || md5(url), i + 1, 1))) AS p FROM pages))""")
def perceptual_hashes(spark, sf):
    grey = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.ascii(F.substring(F.concat(F.md5(F.col("url").cast("binary")), F.md5(F.col("url").cast("binary"))), i, F.lit(1))))
    return table(spark, sf, "pages").select("page_id", K.p_hash(grey).alias("p_hash"))


HASHED = "SELECT user_id % 20 AS video, event_id AS id, CAST(event_id % 1013 AS DOUBLE) / 4 AS t, substr(md5(CAST(event_id % 7 AS STRING)), 1, 16) AS p_hash, substr(md5(CAST(event_id % 5 AS STRING)), 1, 16) AS d_hash FROM {events}"
HAM = "len(list_filter(list_zip(regexp_split_to_array({a}, ''), regexp_split_to_array({b}, '')), lambda z: z[1] <> z[2]))"


@query(f"""WITH RECURSIVE h AS ({plain(HASHED)}), b AS (SELECT video, t FROM h WHERE id % 50 = 0), n AS (SELECT h.*, EXISTS (SELECT 1 FROM b WHERE b.video = h.video AND abs(b.t - h.t) < 2) AS near FROM h), z AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, p_hash, d_hash, near) AS rn FROM n),
    w AS (SELECT video, rn, t, p_hash AS p, d_hash AS d, true AS kept FROM z WHERE rn = 1 UNION ALL SELECT z.video, z.rn, z.t, CASE WHEN k THEN z.p_hash ELSE w.p END, CASE WHEN k THEN z.d_hash ELSE w.d END, k FROM w JOIN z ON z.video = w.video AND z.rn = w.rn + 1,
        LATERAL (SELECT {HAM.format(a="z.p_hash", b="w.p")} / 16e0 * 0.7e0 + {HAM.format(a="z.d_hash", b="w.d")} / 16e0 * 0.3e0 > 0.15 OR z.near OR {HAM.format(a="z.d_hash", b="w.d")} / 16e0 > 0.2 AS k) q)
    SELECT video, t FROM w WHERE kept""")
def distinct_frames(spark, sf):
    h = frame(spark, sf, HASHED)
    return K.distinct_frames(K.near_boundary(h, h.where("id % 50 = 0"), "video"), "video")


@query(f"""WITH RECURSIVE h AS ({plain(HASHED)}), z AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, p_hash, d_hash) AS rn FROM h),
    w AS (SELECT video, rn, t, p_hash AS p, d_hash AS d, true AS kept FROM z WHERE rn = 1 UNION ALL SELECT z.video, z.rn, z.t, CASE WHEN k THEN z.p_hash ELSE w.p END, CASE WHEN k THEN z.d_hash ELSE w.d END, k FROM w JOIN z ON z.video = w.video AND z.rn = w.rn + 1,
        LATERAL (SELECT least({HAM.format(a="z.p_hash", b="w.p")}, {HAM.format(a="z.d_hash", b="w.d")}) > 5 AS k) q)
    SELECT video, t FROM w WHERE kept""")
def distinct_frames_by_digits(spark, sf):
    return K.distinct_frames_by_digits(frame(spark, sf, HASHED).withColumn("near", F.lit(False)), "video")


@query(f"""WITH h AS ({plain(HASHED)}), n AS (SELECT *, id % 9 = 0 AS near FROM h), r AS (SELECT *, count(*) OVER (PARTITION BY video) AS n, count(*) FILTER (near) OVER (PARTITION BY video) AS c, row_number() OVER (PARTITION BY video, near ORDER BY t, id) AS rn FROM n),
    q AS (SELECT *, least(c, 10) AS nb, greatest(1, (n - c) // (20 - least(c, 10))) AS step FROM r)
    SELECT video, id FROM q WHERE n <= 20 OR CASE WHEN near THEN rn <= nb ELSE (rn - 1) % step = 0 AND (rn - 1) / step < 20 - nb END""")
def final_frames(spark, sf):
    h = frame(spark, sf, HASHED).withColumn("near", F.col("id") % 9 == 0).withColumn("t", F.col("t") + F.col("id") / 1e9)
    return K.final_frames(h, "video", 20).select("video", "id")


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start, id) = 1 OR row_number() OVER (PARTITION BY video ORDER BY start DESC, id DESC) = 1 AS edge FROM s)
    SELECT id FROM e WHERE "end" - start >= 8 OR edge OR {unit_sql("id::VARCHAR")} < 1 - 0.7e0""")
def scene_reduction(spark, sf):
    return K.scene_reduction(segs(spark, sf), "video", 8.0, 0.7).select("id")


@query(f"""SELECT id FROM s WHERE coalesce(text, '') <> '' OR "end" - start < 3 OR {unit_sql("id::VARCHAR")} > 0.4e0""")
def motion_reduction(spark, sf):
    s = segs(spark, sf).withColumns({"transcription": F.col("text"), "caption": F.lit(None).cast("string"), "ocr_text": F.lit("")})
    return K.motion_reduction(s, 0.4).select("id")


@query("""SELECT id, start % 30 < 1 OR start % 7 < 1 AS runs, round(CASE WHEN id % 50 > 0 THEN (id % 50 - (id % 7 + id % 5)) / (id % 50)::DOUBLE * 100 ELSE 0 END, 6) AS saved FROM s""")
def sampling_gate(spark, sf):
    i = F.col("id")
    return segs(spark, sf).select("id", K.two_pass_gate(F.col("start"), 30.0, 7.0).alias("runs"), r6(K.reduction(i % 50, i % 7, i % 5)).alias("saved"))


@query("""WITH f AS (SELECT video, arg_min(id, (start, id)) AS fid, arg_min(coalesce(text, ''), (start, id)) AS ft FROM s GROUP BY video)
    SELECT s.id FROM s JOIN f USING (video) WHERE coalesce(trim(text), '') = '' OR trim(ft) = '' OR s.id = fid OR len(list_intersect(list_distinct(string_split(lower(text), ' ')), list_distinct(string_split(lower(ft), ' ')))) / len(list_distinct(list_concat(string_split(lower(text), ' '), string_split(lower(ft), ' ')))) <= 0.8""")
def skip_similar(spark, sf):
    return K.skip_similar(segs(spark, sf), "video", "text").select("id")


@query("""WITH d AS (SELECT id, start, "end" - start AS d FROM s) SELECT 'fps' AS kind, id, round(start + k / 2e0, 6) AS t FROM d, range(0, 200) r(k) WHERE k / 2e0 < d
    UNION ALL SELECT 'target', id, round(start + k * (d / 4), 6) FROM d, range(0, 4) r(k) UNION ALL SELECT 'every', id, round(start + k * 2.5e0, 6) FROM d, range(0, 200) r(k) WHERE k * 2.5e0 < d""")
def rate_times(spark, sf):
    """By frames per second, by a number of times, by distance."""
    each = {"fps": K.rate_times(segs(spark, sf), fps=2.0), "target": K.rate_times(segs(spark, sf), target=4), "every": K.rate_times(segs(spark, sf), every=2.5)}
    return reduce(DataFrame.unionByName, [d.select(F.lit(kind).alias("kind"), "id", r6("t").alias("t")) for kind, d in each.items()])


@query(f"""WITH d AS (SELECT id, start, "end" - start AS d FROM s), c AS (SELECT *, CASE WHEN d < 5 THEN 1 WHEN d < 15 THEN least(2, CAST(ceil(d / 8) AS INT)) ELSE least(4, CAST(ceil(d / 6) AS INT)) END AS c FROM d)
    SELECT id, n, round(start + d / (c + 1) * n + ({unit_sql("id || '|' || n")} - 0.5e0) * CASE WHEN c = 1 THEN least(1, d * 0.1e0) ELSE least(0.5e0, d / (c + 1) * 0.1e0) END, 6) AS t FROM c, range(1, 5) r(n) WHERE n <= c""")
def keyframes_by_duration(spark, sf):
    return K.keyframes_by_duration(segs(spark, sf)).select("id", F.col("n").cast("long").alias("n"), r6("t").alias("t"))


@query("SELECT id, b, \"start\" + x * (\"end\" - \"start\") AS t FROM (SELECT id, 0 AS b, start, \"end\" FROM s) q, (VALUES (0.2e0), (0.4e0), (0.6e0), (0.8e0)) y(x)")
def keyframe_shares(spark, sf):
    return intervals.keyframe_times(segs(spark, sf)).select("id", F.lit(0).alias("b"), F.col("at").alias("t"))


# ---- backfills, context, conversions


@query("SELECT id, path FROM m WHERE id % 3 = 0 UNION ALL SELECT id, min(path) FROM m WHERE id % 2 = 0 AND id % 3 <> 0 GROUP BY id")
def backfilled(spark, sf):
    m = media(spark, sf).select("id", "path")
    once = B.backfill(m.where("id % 3 = 0"), m.where("id % 2 = 0"), "id")
    return B.backfill(once, m.where("id % 2 = 0"), "id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT id FROM m WHERE type = 'image')")
def copied_vectors(spark, sf):
    ids = media(spark, sf).where("type = 'image'").select(F.col("id").alias("vec_id"))
    return B.copy_vectors(table(spark, sf, "embeddings").select("vec_id", "label"), ids, "vec_id")


@query("SELECT type, count(*) AS missing FROM m WHERE id NOT IN (SELECT id FROM m WHERE id % 3 = 0) GROUP BY type")
def missing_by_type(spark, sf):
    m = media(spark, sf)
    return B.missing_by_type(m, m.where("id % 3 = 0"), "id", "type")


@query("""WITH f AS (SELECT id, path AS file_path FROM m WHERE id % 2 = 0), o AS (SELECT path, min(id) AS id, arg_min(created_at, id) AS at FROM m GROUP BY path)
    SELECT s.id, coalesce(a.id, b.id) AS item_id, CAST(round(s.start * 1000) AS BIGINT) AS start_ms, CAST(round(s."end" * 1000) AS BIGINT) AS end_ms, coalesce(a.at, b.at) AS created_at FROM s LEFT JOIN o a ON a.path = '/m/' || (s.id % 90) LEFT JOIN f ON f.id = s.video LEFT JOIN o b ON b.path = f.file_path WHERE coalesce(a.id, b.id) IS NOT NULL""")
def segment_backfill(spark, sf):
    m = media(spark, sf)
    s = segs(spark, sf).select("id", F.col("video").alias("video_id"), F.concat(F.lit("/m/"), (F.col("id") % 90).cast("string")).alias("video_path"), "start", "end")
    return B.segment_rows(s, m, m.where("id % 2 = 0").select("id", F.col("path").alias("file_path")))


@query("SELECT id, coalesce(source_id, k.k) AS source_id FROM m LEFT JOIN (SELECT path, min(source_id) AS k FROM m WHERE source_id IS NOT NULL GROUP BY path) k ON k.path = m.path")
def filled_sources(spark, sf):
    m = media(spark, sf).select("id", "path", "source_id")
    return B.fill_where_known(m, m.where("source_id IS NOT NULL").select("path", "source_id"), "path").select("id", "source_id")


@query("SELECT 'items' AS tab, id FROM m WHERE id % 10 <> 3 UNION ALL SELECT 'segments', id FROM s WHERE video NOT IN (SELECT id FROM m WHERE id % 10 = 3)")
def cascade_delete(spark, sf):
    m = media(spark, sf)
    left = B.cascade(m.where("id % 10 = 3").select("id"), {"items": (m, "id"), "segments": (segs(spark, sf), "video")})
    return left["items"].select(F.lit("items").alias("tab"), "id").unionByName(left["segments"].select(F.lit("segments").alias("tab"), "id"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, vec_id % 3 = 0 AS kept, len(embedding) = 64 AS back FROM embeddings""")
def dimension_change(spark, sf):
    """A third of the vectors has the new dimension already."""
    e = table(spark, sf, "embeddings")
    mixed = e.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    now = B.of_dimension(mixed.withColumn("status", F.lit("completed")), "embedding", 32)
    text = F.to_json(F.map_from_entries(F.transform("embedding", lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v")))))
    back = e.select("vec_id", (B.vector_of_json(text) == F.col("embedding")).alias("back"))
    return now.select("vec_id", "status", F.col("embedding").isNotNull().alias("kept")).join(back, "vec_id")


@query("""WITH x AS (SELECT vec_id, CASE vec_id % 4 WHEN 1 THEN list_concat(embedding, ['nan'::FLOAT]) WHEN 2 THEN list_concat(embedding, embedding, embedding, embedding, embedding, embedding) WHEN 0 THEN embedding END AS e FROM embeddings)
    SELECT vec_id, coalesce(len(list_filter(e, lambda x: isnan(x) OR isinf(x))) = 0, false) AS finite, coalesce(len(e) IN (384, 768, 1024, 1536, 3072), false) AS usual_dimension FROM x""")
def vector_checks(spark, sf):
    """As they are, with an entry that is no number, of a usual length, and none."""
    e, k = F.col("embedding"), F.col("vec_id") % 4
    v = F.when(k == 0, e).when(k == 1, F.concat(e, F.array(F.lit(float("nan")).cast("float")))).when(k == 2, F.concat(*[e] * 6))
    return table(spark, sf, "embeddings").select("vec_id", B.valid_vector(v).alias("v")).select("vec_id", "v.*")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start, id) AS rn FROM s), d AS (SELECT video, rn, text, row_number() OVER (PARTITION BY video ORDER BY rn) AS k FROM c WHERE status = 'completed' AND text IS NOT NULL)
    SELECT c.id, coalesce((SELECT string_agg(d.text, ' / ' ORDER BY d.rn) FROM d WHERE d.video = c.video AND d.rn < c.rn AND d.k > (SELECT count(*) FROM d x WHERE x.video = c.video AND x.rn < c.rn) - 3), '') AS context FROM c""")
def prior_context(spark, sf):
    return B.prior_context(segs(spark, sf), "video").select("id", F.array_join("context", " / ").alias("context"))


@query("""SELECT a.id, coalesce((SELECT string_agg(CAST(q.id AS VARCHAR), ',' ORDER BY q.start, q.id) FROM (SELECT b.id, b.start FROM s b WHERE b.video = a.video AND b."end" < a.start ORDER BY b.start DESC, b.id DESC LIMIT 3) q), '') AS before FROM s a""")
def ended_before(spark, sf):
    return B.ended_before(segs(spark, sf), "video").select("id", F.array_join(F.transform("before", lambda x: x.cast("string")), ",").alias("before"))


@query("SELECT m.id, coalesce(x.sc, m.score) AS score FROM m LEFT JOIN (SELECT id, score * 2 AS sc FROM m WHERE id % 2 = 0) x ON x.id = m.id")
def score_write_back(spark, sf):
    m = media(spark, sf).select("id", "score")
    return B.write_back(m, m.where("id % 2 = 0").withColumn("score", F.col("score") * 2), "id")


@query("""SELECT s.id, CAST(s.start AS BIGINT) / 1000e0 AS start, CAST(floor(s."end") AS BIGINT) / 1000e0 AS "end", coalesce(s.text, '') AS transcription, coalesce(nullif(m.caption, ''), 'own') AS caption, CASE WHEN m.id IS NULL THEN '' ELSE trim(coalesce(m.mime, '') || ' ' || m.type) END AS scene FROM s LEFT JOIN m ON m.id = s.id""")
def player_segments(spark, sf):
    s = segs(spark, sf).select("id", F.col("start").cast("long").alias("start_ms"), F.floor("end").alias("end_ms"), F.col("text").alias("transcript"), F.lit("own").alias("caption"))
    e = media(spark, sf).select("id", "caption", F.col("mime").alias("caption_elements"), F.lit("").alias("caption_spatial"), F.col("type").alias("caption_temporal"))
    return B.player_rows(s, e)


@query("""SELECT video, coalesce(string_agg(text, ' | ' ORDER BY id) FILTER (text <> ''), '') AS spatial, coalesce(string_agg(status, ' | ' ORDER BY id), '') AS temporal, array_to_string(list_distinct_ordered, ',') AS elements FROM (
    SELECT s.*, (SELECT list(e ORDER BY k) FROM (SELECT text AS e, min(id) AS k FROM s x WHERE x.video = s.video AND text IS NOT NULL GROUP BY text)) AS list_distinct_ordered FROM s) GROUP BY video, list_distinct_ordered""")
def keyframe_context(spark, sf):
    f = segs(spark, sf).select("video", F.col("id").alias("position"), F.col("text").alias("spatial"), F.col("status").alias("temporal"), F.when(F.col("text").isNotNull(), F.array("text")).alias("elements"))
    return B.keyframe_context(f, "video").select("video", "spatial", "temporal", F.array_join("elements", ",").alias("elements"))


@query("""SELECT video, round(least(1, least(max(length(coalesce(text, ''))) / 500e0, 1) * 0.4e0 + avg(score) * 0.3e0 + CASE WHEN max(length(thumbnail)) > 8 THEN 0 ELSE 0 END + CASE WHEN bool_or(coalesce(text, '') <> '') THEN 0.1e0 ELSE 0 END), 6) AS score, CAST(sum(length(coalesce(text, '')) + length(thumbnail)) AS BIGINT) AS chars FROM s GROUP BY video""")
def batch_quality(spark, sf):
    s = segs(spark, sf).withColumns({"confidence": F.col("score"), "spatial": F.col("text"), "temporal": F.col("status")})
    q = B.batch_quality(s, "video", "text", "thumbnail")
    return q.select("video", r6("score").alias("score")).join(s.groupBy("video").agg(F.sum(B.content_chars("text", "thumbnail")).alias("chars")), "video")


@query("SELECT count(*) AS total, max(pass) AS depth FROM m")
def store_totals(spark, sf):
    return B.store_totals(media(spark, sf).groupBy("pass").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("pass", "depth"))


@query("""WITH c AS (SELECT page_id, '/v/' || page_id || '.x.mp4' AS p FROM pages),
    h AS (SELECT *, list_reduce(list_transform(string_split(substr(p || html, 1, 100), ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM (SELECT c.*, html FROM c JOIN pages USING (page_id)))
    SELECT page_id, regexp_replace(split_part(p, '/', -1), '\\.[^.]*$', '') || '_' || substr(regexp_replace(to_base64(encode(p)), '[/+=]', '', 'g'), 1, 8) AS cache_name, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM h""")
def cache_names(spark, sf):
    p = F.concat(F.lit("/v/"), F.col("page_id").cast("string"), F.lit(".x.mp4"))
    return B.snake_columns(table(spark, sf, "pages").select("page_id", B.cache_name(p).alias("cacheName"), B.text_hash(F.concat(p, "html")).alias("hash")))


@query("""WITH w AS (SELECT page_id, page_id % 3 AS k, 'o' || (page_id % 41) AS a, 'p' || (page_id % 37) AS b, 'm' || (page_id % 7) AS c FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN a || ',' || b WHEN 1 THEN b ELSE 'unknown' END AS objects, CASE k WHEN 1 THEN a ELSE '' END AS people, CASE k WHEN 1 THEN c ELSE 'unknown' END AS lighting, CASE k WHEN 0 THEN c END AS mood FROM w""")
def extracted_elements(spark, sf):
    """Texts of the pages' own words: objects, labelled lines, neither."""
    k, a, b, c = F.col("page_id") % 3, *[F.concat(F.lit(x), (F.col("page_id") % n).cast("string")) for x, n in (("o", 41), ("p", 37), ("m", 7))]
    text = F.when(k == 0, F.format_string('{"objects":["%s","%s"],"mood":"%s"}', a, b, c)).when(k == 1, F.format_string("OBJECTS: [%s]\nPEOPLE: %s, none\nLIGHTING: %s", b, a, c)).otherwise(F.concat(a, b))
    e = table(spark, sf, "pages").select("page_id", B.extracted_elements(text).alias("e"))
    return e.select("page_id", F.array_join("e.objects", ",").alias("objects"), F.array_join("e.people", ",").alias("people"), "e.lighting", "e.mood")


@query("""WITH l AS (SELECT item_id AS id, item_id % 50 * 60 + item_id * 7 % 60 AS a, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 9) AS w FROM benchmark)
    SELECT id, k AS n, CASE WHEN id % 2 = 0 THEN a + k * 3600 + 0.5e0 ELSE a + 0e0 END AS start, CASE WHEN id % 2 = 0 THEN CASE k WHEN 0 THEN w || chr(10) || 'more' ELSE 'x' || w END ELSE w END AS transcription FROM l, range(0, 2) r(k) WHERE id % 2 = 0 OR k = 0""")
def transcript_rows(spark, sf):
    """Two lines, of them one over two rows and one an hour later, a line without words between them; or a text without lines."""
    i, w = F.col("item_id"), F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 9)
    at = F.format_string("%02d:%02d.", (i % 50).cast("int"), (i * 7 % 60).cast("int"))
    line = lambda hour, text: F.concat(F.lit(f"[{hour}:"), at, F.lit("500 --> "), F.lit(f"{hour}:"), at, F.lit("900] "), text)
    raw = F.concat(line("00", w), F.lit("\nmore\n"), line("00", F.lit(" ")), F.lit("\n"), line("01", F.concat(F.lit("x"), w)))
    a = (i % 50 * 60 + i * 7 % 60).cast("double")
    s = table(spark, sf, "benchmark").select(i.alias("id"), a.alias("start"), (a + 9).alias("end"), F.when(i % 2 == 0, raw).otherwise(w).alias("transcription"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("start")) - 1
    return intervals.transcript_rows(s).select("id", place.cast("long").alias("n"), "start", "transcription")


@query("SELECT path, arg_max(id, (created_at, id)) AS id, arg_max(status, (created_at, id)) AS status, count(*) AS n, bool_or(status IN ('pending', 'running')) AS active FROM j GROUP BY path")
def status_of_paths(spark, sf):
    return jobs.status_of_paths(frame(spark, sf, JOBS))


@query("SELECT id, path FROM j WHERE status IN ('pending', 'scheduled') ORDER BY created_at, id LIMIT 30")
def listed_jobs(spark, sf):
    return jobs.listed(frame(spark, sf, JOBS), ["pending", "scheduled"], 30).select("id", "path")


# ---- streams


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return streams.event_stream(spark, f"{sf}/events.parque[t]", schema)  # a pattern, since the table may be one file


@query("SELECT event_id, user_id, event_type FROM events")
def job_event_log(spark, sf):
    path = scratch(spark, "event-log")
    streams.append_events(event_stream(spark, sf).select("event_id", "user_id", "event_type"), path)
    return spark.read.parquet(path)


def in_batches(spark, rows, order, batches=4, files=2):
    """``rows`` as a folder of files that arrive one batch after the other, in the order of a column; and its stream, a batch at a time."""
    path = scratch(spark, "arriving")
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    for k in range(batches if hi is not None else 0):
        part = rows.where((F.col(order) >= lo + (hi + 1 - lo) * k // batches) & (F.col(order) < lo + (hi + 1 - lo) * (k + 1) // batches))
        part.repartition(files).write.mode("append").parquet(path)
    if hi is None:
        rows.write.parquet(path)
    return streams.event_stream(spark, path, rows.schema, files)


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS state, max(ts) AS at, count(*) AS n FROM events GROUP BY 1")
def job_state_stream(spark, sf):
    path = scratch(spark, "job-states")
    streams.job_states(in_batches(spark, table(spark, sf, "events"), "event_id"), path, "user_id", "ts", "event_type")
    return streams.read_states(spark, path, "user_id")


#: A job's events by what happened to a user.
JOB_EVENTS = {"signup": "created", "click": "started", "error": "failed", "purchase": "completed"}

#: The machine over the whole log: one step for each event of a job; a stall lies before the event that shows it, or at the end.
JOB_LOG = """WITH RECURSIVE e AS (SELECT user_id AS job, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'started' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' END AS event FROM events),
    z AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ms, event) AS k FROM e WHERE event IS NOT NULL), wm AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS wm FROM events WHERE event_type IN ('signup', 'click', 'error', 'purchase')),
    w AS (SELECT job, 0::BIGINT AS k, NULL::BIGINT AS ms, NULL::VARCHAR AS status, 0 AS retries, NULL::BIGINT AS deadline, NULL::BIGINT AS stall, 0 AS was, false AS told FROM (SELECT DISTINCT job FROM z)
        UNION ALL SELECT z.job, z.k, z.ms, n.new, CASE WHEN z.event = 'created' AND (c.now IS NULL OR c.now IN ('completed', 'failed')) THEN 0 WHEN z.event = 'failed' AND c.now IN ('running', 'stalled') THEN w.retries + 1 ELSE w.retries END,
            CASE WHEN n.new IS NOT DISTINCT FROM c.now THEN CASE WHEN c.stalls THEN NULL ELSE w.deadline END WHEN n.new = 'pending' THEN z.ms + 300000 WHEN n.new = 'running' THEN z.ms + 1200000 END,
            CASE WHEN c.stalls THEN w.deadline END, w.retries, n.new IS DISTINCT FROM c.now
        FROM w JOIN z ON z.job = w.job AND z.k = w.k + 1, LATERAL (SELECT coalesce(z.ms > w.deadline, false) AS stalls, CASE WHEN coalesce(z.ms > w.deadline, false) THEN 'stalled' ELSE w.status END AS now) c,
            LATERAL (SELECT CASE WHEN z.event = 'created' AND (c.now IS NULL OR c.now IN ('completed', 'failed')) THEN 'pending' WHEN z.event = 'started' AND c.now IN ('pending', 'stalled') THEN 'running' WHEN z.event = 'completed' AND c.now IN ('running', 'stalled') THEN 'completed'
                WHEN z.event = 'failed' AND c.now IN ('running', 'stalled') THEN CASE WHEN w.retries + 1 < 3 THEN 'pending' ELSE 'failed' END ELSE c.now END AS new) n),
    t AS (SELECT job, ms, status, retries FROM w WHERE told UNION ALL SELECT job, stall, 'stalled', was FROM w WHERE stall IS NOT NULL
        UNION ALL SELECT job, deadline, 'stalled', retries FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY k DESC) AS o FROM w), wm WHERE o = 1 AND deadline < wm)"""


def job_log(spark, sf):
    path, names = scratch(spark, "job-transitions"), F.create_map(*[F.lit(x) for kv in JOB_EVENTS.items() for x in kv])
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", names[F.col("event_type")].alias("event")).where("event IS NOT NULL")
    streams.job_transitions(in_batches(spark, rows, "event_id"), path, "user_id", "ts", "event")
    return spark.read.schema("job long, at long, status string, retries int, n int").parquet(path)


@query(JOB_LOG + " SELECT job, ms AS \"at\", status, retries FROM t")
def job_transitions(spark, sf):
    return job_log(spark, sf).select("job", "at", "status", "retries")


@query(JOB_LOG + ", o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ms DESC) AS o FROM t) SELECT job, ms AS \"at\", status, retries FROM o WHERE o = 1")
def job_last_status(spark, sf):
    return streams.last_transitions(job_log(spark, sf))


@query("SELECT DISTINCT user_id, round(epoch_us(ts) / 1e6, 3) AS start, round(epoch_us(ts) / 1e6 + value, 3) AS \"end\" FROM events WHERE value > 0")
def early_segments(spark, sf):
    """Every segment is told twice, the second time ten minutes later and mostly in another batch."""
    path, start = scratch(spark, "early-segments"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf, "events").select("user_id", start.alias("start"), (start + F.col("value")).alias("end"), F.explode(F.array(F.lit(0), F.lit(600))).alias("late"))
    rows = rows.withColumn("second", F.floor("start") + F.col("late")).withColumn("at", F.timestamp_seconds("second"))
    streams.early_segments(in_batches(spark, rows, "second"), path, "user_id", "at")
    return spark.read.parquet(path).select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


# ---- stores


@query(bm_sql(["thing", "under"]) + ", p AS (SELECT doc_id, bm25 FROM b ORDER BY bm25, doc_id LIMIT 80), x AS (SELECT doc_id AS id, CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 1 ELSE 1 - (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS score FROM p), k AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS d FROM embeddings ORDER BY d, vec_id LIMIT 320) SELECT * FROM (SELECT x.id, round(x.score, 5) AS score, 'text' AS store FROM x JOIN m ON m.id = x.id WHERE type LIKE 'image%' UNION ALL (SELECT k.id, round(exp(-d / 8), 5), 'vector' FROM k JOIN m ON m.id = k.id WHERE type LIKE 'video%' ORDER BY exp(-d / 8) DESC, k.id LIMIT 80))")
def single_stores(spark, sf):
    from glimmer.operators import vectors
    from glimmer.plans.registry import first_vector

    m = media(spark, sf).select("id", "type", "created_at")
    text = stores.TextStore(spark, held(spark, sf), m, "image")
    near = stores.VectorStore(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), m, lambda _: first_vector(spark, sf), "video", vectors.exponential)
    parts = [s.search("thing under", 80).select("id", F.round("score", 5).alias("score"), F.lit(n).alias("store")) for n, s in (("text", text), ("vector", near))]
    return parts[0].unionByName(parts[1])


@query(bm_sql(["thing", "under"]) + """, p AS (SELECT doc_id, bm25 FROM b ORDER BY bm25, doc_id LIMIT 40), x AS (SELECT doc_id AS id, CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 1 ELSE 1 - (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS score FROM p),
    k AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS d FROM embeddings ORDER BY d, vec_id LIMIT 160),
    u AS (SELECT x.id, x.score, created_at FROM x JOIN m ON m.id = x.id WHERE type LIKE 'image%' UNION ALL (SELECT k.id, exp(-d / 8), created_at FROM k JOIN m ON m.id = k.id WHERE type LIKE 'video%' ORDER BY exp(-d / 8) DESC, k.id LIMIT 40)),
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC, created_at DESC NULLS LAST, id) AS place FROM u)
    SELECT id, round(score, 5) AS score, place, (SELECT count(*) FROM u) AS total, 1 AS depth, nid AS next_id, nid IS NOT NULL AS has_more FROM o LEFT JOIN (SELECT id AS nid FROM o WHERE place = 40 AND created_at IS NOT NULL) l ON true WHERE place <= 40""")
def search_everywhere(spark, sf):
    from glimmer.operators import vectors
    from glimmer.plans.registry import first_vector

    m = media(spark, sf).select("id", "type", "created_at")
    each = [stores.TextStore(spark, held(spark, sf), m, "image"), stores.VectorStore(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), m, lambda _: first_vector(spark, sf), "video", vectors.exponential)]
    out = stores.search_all(each, "thing under", 40)
    return out.select("id", F.round("score", 5).alias("score"), "place", "total", "depth", "next_id", "has_more")


@query("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({c} = '{s}') AS {n}_{s}" for n, c in (("caption", "caption_status"), ("embedding", "status")) for s in ("completed", "pending", "failed")) + " FROM m")
def phase_stats(spark, sf):
    return stores.phase_stats(media(spark, sf), F.col("caption_status"), F.col("status"))
