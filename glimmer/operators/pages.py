"""Pages with cursors over a copy of a listing that is clustered by (order, key), so that a page opens only the files it lies in.

The copy is range-partitioned by (whether there is a value, value, key); a value that many rows share is split by key. For each file
and for its rows with and without a value, one row of ``zones`` tells how many there are and which is the first and the last. A page
reads the zones that can lie after its cursor, in order, as many as the page has rows at most, and from the files of these only
those that are needed to fill it; no folder is listed. The copy stands for the rows as they were when it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators.listing import page_after

#: Rows in a file of the copy, about.
FILE_ROWS = 200_000


def write_clustered(rows: DataFrame, path: str, order: str, key: str, file_rows: int = FILE_ROWS) -> None:
    """Write ``rows`` (read three times: counted, sampled for the ranges, written) and their zones. Keys are not null."""
    spark = rows.sparkSession
    by = [F.col(order).isNull(), F.col(order), F.col(key)]
    parts = max(1, -(-rows.count() // file_rows))
    rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    at = F.struct(F.col(order).alias("value"), F.col(key).alias("key"))
    each = written.select(F.col("_metadata.file_path").alias("file"), F.col(order).isNull().alias("none"), at.alias("at"))
    zones = each.groupBy("file", "none").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    zones.repartitionByRange("none", "first").sortWithinPartitions("none", "first").write.mode("overwrite").parquet(f"{path}/zones")


def _reaches(after: tuple, descending: bool) -> Column:
    """Zones that may hold rows after the cursor: their far end is not before it."""
    value, k = after
    end = "first" if descending else "last"
    key = F.col(f"{end}.key")
    key_past = key < F.lit(k) if descending else key > F.lit(k)
    if value is None:
        return F.col("none") & key_past
    v = F.col(f"{end}.value")
    past = v < F.lit(value) if descending else v > F.lit(value)
    return F.col("none") | past | ((v == F.lit(value)) & key_past)


def files_of_page(spark: SparkSession, path: str, after: tuple | None, descending: bool, limit: int) -> list[str]:
    """The files that hold the ``limit`` + 1 rows after the cursor; the driver gets at most ``limit`` + 2 zones.

    Only the first zone can hold rows before the cursor too, so it counts for one row, which it has after the cursor.
    """
    zones = spark.read.parquet(f"{path}/zones")
    if after is not None:
        zones = zones.where(_reaches(after, descending))
    far = [F.desc("last.value"), F.desc("last.key")] if descending else [F.asc("first.value"), F.asc("first.key")]
    files: list[str] = []
    held = 0
    for z in zones.orderBy("none", *far).limit(limit + 2).select("file", "n").collect():
        if held > limit:
            break
        held += z["n"] if after is None or files else 1
        files.append(z["file"])
    return list(dict.fromkeys(files))


def clustered_page(spark: SparkSession, path: str, order: str, key: str, after: tuple | None = None, descending: bool = True, limit: int = 20) -> DataFrame:
    """What ``listing.page_after`` gives for all rows, from the files that the page needs. ``order`` and ``key`` as written."""
    files = files_of_page(spark, path, after, descending, limit)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    return page_after(rows, order, after, descending, limit, key)
