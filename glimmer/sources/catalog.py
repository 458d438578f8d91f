"""Loaders of the parquet tables and sinks used by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.session import ship_package

IMAGES = ["jpg", "jpeg", "png", "gif", "bmp", "webp"]
VIDEOS = ["mp4", "mov", "avi", "mkv", "webm", "m4v"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timeline segments: id, user_id, start and end (seconds; a segment lasts ``value``), score."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.where(F.col("value") >= 0).select(F.col("event_id").alias("id"), "user_id", start.alias("start"), (start + F.col("value")).alias("end"), F.col("value").alias("score"))


def scan_media(spark: SparkSession, path: str, extensions: list[str] = IMAGES, recursive: bool = True) -> DataFrame:
    """Files of the given kinds (listing only: contents are not read)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")
    return found.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(extensions))


def count_media(spark: SparkSession, path: str, extensions: list[str] = IMAGES, recursive: bool = True) -> int:
    """Number of files that ``scan_media`` lists."""
    return scan_media(spark, path, extensions, recursive).count()


def write_storyline(segments: DataFrame, path: str) -> None:
    """One JSON object per video with its segments in time order."""
    segments.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("start", "end", "id", "text"))).alias("segments")).write.json(path)
