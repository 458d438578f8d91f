"""Catalog work: listings, pagination, deduplication, upserts, grouped statistics, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, ts: str, key: str, after_ts=None, after_key=None, limit: int = 20) -> DataFrame:
    """A page in (ts desc, key desc) order after a cursor, compared to the second; limit + 1 rows tell whether more follow."""
    second = F.date_trunc("second", F.col(ts))
    if after_ts is not None:
        at = F.date_trunc("second", F.lit(after_ts).cast("timestamp_ntz"))
        df = df.where((second < at) | ((second == at) & (F.col(key) < F.lit(after_key))))
    return df.orderBy(second.desc(), F.col(key).desc()).limit(limit)


def offset_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """Up to ``n`` first rows of each group; tasks cut to n per group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row by ``order`` for each key, by an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def oldest_with_ties(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that share the smallest ``order`` of their key."""
    least = df.groupBy(*keys).agg(F.min(order).alias("_m")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_m")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(least, [*on, F.col(order) == F.col("_m")], "left_semi")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """Rows of both, new ones winning by key (or, with ``keep_old``, only those whose key is not there); keys compare null-safe."""
    first, second = (new, current) if not keep_old else (current, new)
    on = [first[k].eqNullSafe(second[k]) for k in keys]
    return first.unionByName(second.join(first, on, "left_anti"))


def patch(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null values of ``changes`` replace those of ``current``."""
    cols = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return current.join(renamed, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in current.columns])


def without_active(items: DataFrame, jobs: DataFrame, key: str, status: str, active: list[str]) -> DataFrame:
    """Items that no active job covers."""
    return items.join(jobs.where(F.col(status).isin(active)).select(key), key, "left_anti")


def job_rollup(jobs: DataFrame, group: str, status: str, created: str, done: str, failed: str, pending: str) -> DataFrame:
    """Per group: totals by status, first creation, percent done; only groups with open work."""
    out = jobs.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == done).alias("completed"), F.count_if(F.col(status) == failed).alias("failed"),
        F.count_if(F.col(status) == pending).alias("pending"), F.min(created).alias("first_created"),
    )
    out = out.where((F.col("pending") > 0) | (F.col("completed") + F.col("failed") < F.col("total")))
    return out.withColumn("progress", F.floor(100 * F.col("completed") / F.col("total")).cast("long"))


def stalled(jobs: DataFrame, status: str, ts: str, now: str, minutes: dict[str, int]) -> DataFrame:
    """Jobs longer in a status than its minutes allow, as of an explicit ``now``."""
    at = F.lit(now).cast("timestamp")
    cond = F.lit(False)
    for s, m in minutes.items():
        cond = cond | ((F.col(status) == s) & (F.col(ts).cast("timestamp") < at - F.expr(f"INTERVAL {m} MINUTES")))
    return jobs.where(cond)


def next_state(status: Column, ok: Column, retries: Column, most: int = 3) -> Column:
    """struct(status, retries) after a report: completed; pending again while retries are left; else failed."""
    up = retries + 1
    return F.struct(F.when(ok, "completed").when(up < most, "pending").otherwise("failed").alias("status"), F.when(ok, retries).otherwise(up).alias("retries"))


def item_id(path: Column) -> Column:
    """First 32 hex digits of the path's SHA-256 as 8-4-4-4-12."""
    h = F.sha2(path, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def collapse_fragments(rows: DataFrame, url: str, score: str, key: str) -> DataFrame:
    """One row per base address: best score and its key, number of matches, matching keys in order."""
    base = F.substring_index(F.col(url), "#", 1)
    return rows.withColumn("base", base).groupBy("base").agg(F.max(F.struct(score, F.negate(key).alias("k"))).alias("m"), F.count(F.lit(1)).alias("matches"), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("members")).select("base", F.negate("m.k").alias("best"), F.col(f"m.{score}").alias("score"), "matches", "members")


def grouped_by_source(results: DataFrame, sources: DataFrame) -> DataFrame:
    """A page of results (id, source_id, place) by source: source_id, its name ('Unknown Source' where ``sources``, (id, name), has none),
    its number of results and their ids in order."""
    own = results.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return own.join(named, "source_id", "left").select("source_id", F.coalesce("source", F.lit("Unknown Source")).alias("source"), "n", "first", "ids")
