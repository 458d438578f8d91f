"""A table of buckets by key that is changed in place: only buckets that hold a changed key are written again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODE = "spark.sql.sources.partitionOverwriteMode"
BUCKETS = 256


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table without its bucket column; None where there is none yet."""
    try:
        return spark.read.parquet(path).drop("bucket")
    except AnalysisException:
        return None


def write_changes(changes: DataFrame, path: str, key: str, keep_old: bool = False, gone: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Insert or replace rows by key (``keep_old``: rows whose key is there already change nothing), and delete the keys of ``gone``.

    Of several changes to a key the smallest row counts. Buckets without a change keep their files; running the same changes again
    gives the same table, so a run that was cut off is simply repeated. Columns are those of the table, or of the first changes.
    Returns the buckets written, at most ``buckets`` numbers. One writer at a time; ``changes`` do not read the table.
    """
    spark = changes.sparkSession
    rest = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    drop = changes.select(key).where("false") if gone is None else gone.select(key).distinct()
    old = read_table(spark, path)
    touched = new.select(key).unionByName(drop).select(bucket(key, buckets).alias("bucket")).distinct()
    touched = sorted(r["bucket"] for r in touched.collect())  # at most as many as there are buckets
    if not touched:
        return []
    if old is None:
        merged = new
    else:
        held = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket").select(*new.columns)
        first, second = (held, new) if keep_old else (new, held)
        merged = first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))
    merged = merged.join(drop, key, "left_anti").select(*new.columns).withColumn("bucket", bucket(key, buckets))
    # a bucket that lost its last row gets no file, so its folder is deleted
    kept = {r["bucket"] for r in merged.select("bucket").distinct().collect()}
    before = spark.conf.get(MODE)
    spark.conf.set(MODE, "dynamic")
    try:
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    finally:
        spark.conf.set(MODE, before)
    for b in touched:
        if b not in kept:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return touched
