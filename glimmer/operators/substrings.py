"""Substring search over an index of character trigrams.

A row that holds a needle holds all of its trigrams. So the postings of these are intersected, and only what is left is looked at
as a whole. Needles of fewer than three characters have no trigram: for them all rows are looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.operators.listing import holds
from glimmer.session import ship_package

GRAM = 3
#: Folders that a trigram's postings may lie in, and parts in which a folder is written.
FOLDERS, PARTS = 64, 8
#: Keys of candidates that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _folder(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % FOLDERS).cast("int")


def write_trigrams(rows: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """(gram, field, keys) for the distinct trigrams of the lower-cased columns, in folders by a hash of the gram, sorted by gram.

    A row's trigrams are made distinct in the row, and the keys of a batch of rows are put together for each trigram before they are
    shuffled; a common trigram has many writers.
    """
    ship_package(rows.sparkSession)
    fields = [rows.select(F.col(key).alias("key"), F.lit(i).alias("field"), F.lower(F.col(c)).alias("text")) for i, c in enumerate(columns)]
    every = reduce(DataFrame.unionByName, fields).where(F.length("text") >= GRAM)
    each = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))  # in one pass over the text, however long it is
    grams = every.select("key", "field", F.array_distinct(each).alias("grams"))
    kind = T.StructType([T.StructField("gram", T.StringType()), T.StructField("field", T.IntegerType()), T.StructField("keys", T.ArrayType(grams.schema["key"].dataType))])
    posts = grams.mapInArrow(_together, kind).withColumn("folder", _folder(F.col("gram")))
    posts.repartition("folder", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(PARTS))).sortWithinPartitions("folder", "gram", "field").write.mode("overwrite").partitionBy("folder").parquet(path)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, field, grams) of a batch as (gram, field, keys)."""
    for rb in batches:
        key, field, grams = rb.columns
        if not rb.num_rows:
            continue
        texts = grams.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(key)), pc.list_value_length(grams).to_numpy(zero_copy_only=False))
        fields = field.to_numpy(zero_copy_only=False)[row]
        at = texts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (int(fields.max()) + 1) + fields
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
        keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), key.take(pa.array(row[order])))
        begin = pa.array(order[first])
        yield pa.RecordBatch.from_arrays([texts.dictionary.take(texts.indices.take(begin)), pa.array(fields[order[first]], pa.int32()), keys], names=["gram", "field", "keys"])


def candidates(spark: SparkSession, path: str, needle: str, columns: list[str], wanted: list[str]) -> DataFrame | None:
    """Keys of the rows that hold all trigrams of the needle in one of the columns; None for a needle without trigrams."""
    low = needle.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return None
    places = sorted({zlib.crc32(g.encode()) % FOLDERS for g in grams})
    posts = spark.read.parquet(path).where(F.col("folder").isin(places) & F.col("gram").isin(grams) & F.col("field").isin([columns.index(c) for c in wanted]))
    # the postings hold a key once for each gram and field
    return posts.select("field", F.explode("keys").alias("key")).groupBy("key", "field").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") == len(grams)).select("key").distinct()


def holding(rows: DataFrame, path: str, needle: str, key: str, columns: list[str], wanted: list[str] | None = None) -> DataFrame:
    """The rows that hold the needle in any of the ``wanted`` columns (of those that are indexed: ``columns``), whatever its letter
    case. Only candidates are verified; ``rows``: what was indexed, its keys are not null."""
    wanted = wanted or columns
    found = candidates(rows.sparkSession, path, needle, columns, wanted)
    if found is not None:
        found = found.withColumnRenamed("key", key)
        rows = rows.join(F.broadcast(found) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else found, key, "left_semi")
    return rows.where(holds(needle, *[F.col(c) for c in wanted]))
