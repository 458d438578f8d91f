"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every scan task hashes its normalised texts and, for each owner of a range of 48-bit fingerprints, sends one
   message: its sorted fingerprints there as Golomb (Rice) coded differences.
2. Owners decode the messages and answer each with a bitmap: which of its fingerprints occur more than once.
3. Senders read their bitmaps against their own messages; the marked fingerprints are the suspects.
4. Only texts with a suspect fingerprint are shuffled, pre-aggregated by (hash, whole text) on the map side, so
   equality of bytes decides and a text that a third of all rows share travels once per task. They are picked by
   their row numbers, file by file where these are too many to broadcast at once.

Null text counts as empty; empty texts are equal to each other. Null doc_ids never stay in a group that has
a row with an id; of a group of null ids only, keep_id is null and the first row in the order of the files stays.
Rows that repeat a doc_id with the same text all count in group_size. ``exact_dedup`` speaks of doc_ids and marks
all rows of the kept one (as its SQL does); ``drop_duplicates`` leaves exactly one row of a group, the first in
the order of the files among those with the smallest doc_id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import BROADCAST_ROWS, fresh, give_back, join_spread, new_path, numbered, pick_rows, prepare, shuffle_partitions, small, stage, text_or_empty

#: Bits of a fingerprint; two different texts that share one are told apart by their bytes.
BITS = 48
#: Fingerprints that one owner gets, on average, at most.
OWNED = 2_000_000
#: Values whose bits are spread at once.
SPREAD = 1 << 14


def normalised(text: Column | str = "text") -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as Rice-coded differences: parameter, count, unary stream, remainder stream."""
    v = np.asarray(values, np.uint64)
    d = np.diff(v, prepend=np.uint64(0))
    mean = float(v[-1]) / len(v) if len(v) else 0.0
    k = max(0, int(np.log2(mean * 0.69))) if mean > 2 else 0
    stops = np.cumsum((d >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if len(v) else 0, np.uint8)
    unary[stops] = 1
    bits = np.arange(k, dtype=np.uint64)
    rest = [np.packbits(((d[i : i + SPREAD, None] >> bits) & np.uint64(1)).astype(np.uint8)).tobytes() for i in range(0, len(d), SPREAD)]  # whole bytes each
    return np.array([k, len(v), len(unary)], "<u4").tobytes() + np.packbits(unary).tobytes() + b"".join(rest)


def rice_decode(data: bytes) -> np.ndarray:
    k, n, bits = (int(x) for x in np.frombuffer(data, "<u4", 3))
    raw = np.frombuffer(data, np.uint8, offset=12)
    cut = (bits + 7) // 8
    high = np.diff(np.flatnonzero(np.unpackbits(raw[:cut])[:bits]), prepend=-1) - 1
    low, shifts = np.zeros(n, np.uint64), np.arange(k, dtype=np.uint64)
    for i in range(0, n if k else 0, SPREAD):
        some = raw[cut + i * k // 8 : cut + (min(i + SPREAD, n) * k + 7) // 8]
        m = min(SPREAD, n - i)
        low[i : i + m] = (np.unpackbits(some)[: m * k].reshape(m, k).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def _messages(sender: int, prints: np.ndarray, owners: int) -> list[tuple]:
    """(sender, owner, payload) for each owner; fingerprints are relative to the owner's range."""
    width = -(-(1 << BITS) // owners)
    prints = np.sort(prints.astype(np.uint64))
    owner = (prints // np.uint64(width)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    return [(sender, int(o[0]), rice_encode(p - np.uint64(int(o[0]) * width))) for p, o in zip(np.split(prints, cuts), np.split(owner, cuts), strict=True) if len(p)]


def exchange(docs: DataFrame, text: str = "text", row: str = "row") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_sha256, print, row) of every document, and the suspect fingerprints (print), both staged."""
    spark = docs.sparkSession
    prepare(spark)
    owners = max(shuffle_partitions(spark), -(-docs.select(F.lit(1)).count() // OWNED))
    width = -(-(1 << BITS) // owners)
    hashed = docs.select("doc_id", F.sha2(normalised(text), 256).alias("text_sha256"), F.col(row).alias("row"))
    hashed = hashed.select(F.col("doc_id").cast("long").alias("doc_id"), "text_sha256", F.conv(F.substring("text_sha256", 1, BITS // 4), 16, 10).cast("long").alias("print"), "row")

    def send(batches):
        sender, prints = TaskContext.get().partitionId(), []
        for rb in batches:
            prints.append(rb.column(2).to_numpy(zero_copy_only=False))
            n = rb.num_rows
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(["row"] * n)], names)
        if prints and (out := _messages(sender, np.concatenate(prints), owners)):
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary()), pa.array(["message"] * n)], names)

    names = ["doc_id", "text_sha256", "print", "row", "sender", "owner", "payload", "kind"]
    path = new_path(spark, "exchange")
    schema = "doc_id long, text_sha256 string, print long, row long, sender int, owner int, payload binary, kind string"
    hashed.mapInArrow(send, schema).write.partitionBy("kind").parquet(path)
    both = spark.read.schema(schema).parquet(path)
    rows = both.where(F.col("kind") == "row").select("doc_id", "text_sha256", "print", "row")
    sent = both.where(F.col("kind") == "message").select("sender", "owner", "payload")

    def answer(key, table):
        """An owner's bitmaps, one for each message."""
        lists = [rice_decode(x.as_py()) for x in table.column("payload")]
        value, count = np.unique(np.concatenate(lists), return_counts=True)
        twice = value[count > 1]
        maps = [np.packbits(np.isin(x, twice, assume_unique=False)).tobytes() for x in lists]
        give_back()
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "bitmap": pa.array(maps, pa.binary())})

    bitmaps = sent.groupBy("owner").applyInArrow(answer, "sender int, owner int, bitmap binary")
    replies = sent.join(bitmaps, ["sender", "owner"])

    def mark(batches):
        for rb in batches:
            found = []
            for owner, payload, bitmap in zip(*(rb.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                own = rice_decode(payload)
                hit = np.unpackbits(np.frombuffer(bitmap, np.uint8))[: len(own)].astype(bool)
                found.append(np.unique(own[hit]) + np.uint64(owner * width))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64) if found else [], pa.int64())], ["print"])

    suspects = replies.mapInArrow(mark, "print long").distinct()
    return rows, stage(suspects, "suspects")


def duplicate_groups(docs: DataFrame, rows: DataFrame, suspects: DataFrame, text: str, row: str) -> DataFrame:
    """Groups of at least two rows of equal text: text_sha256, keep_id, group_size; staged. rows: as from ``exchange``."""
    wanted = stage(rows.join(small(suspects), "print", "left_semi").select(F.col("row").alias(row)), "suspect-rows")
    body = pick_rows(docs, row, wanted).select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text).alias("body")).withColumn("text_sha256", F.sha2("body", 256))
    groups = body.groupBy("text_sha256", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return stage(groups.where(F.col("group_size") > 1).select("text_sha256", "keep_id", "group_size"), "groups")


def keepers(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The one row that stays of each group: text_sha256, stays (smallest row of those with the keep_id); staged."""
    first = rows.join(small(groups), "text_sha256").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return stage(first.groupBy("text_sha256").agg(F.min("row").alias("stays")), "keepers")


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with what ``groups`` say of their text, or nulls; beyond a broadcast a text of many rows is dealt out."""
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), "text_sha256", "left")
    return join_spread(rows, groups, ["text_sha256"], how="left")


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = numbered(docs.select("doc_id", text), "dedup-input", "_row")
    rows, suspects = exchange(docs, text, "_row")
    groups = duplicate_groups(docs, rows, suspects, text, "_row")
    nameless = keepers(rows, groups.where(F.col("keep_id").isNull()))
    told = groups.join(small(nameless), "text_sha256", "left")  # one row for each text on both sides
    out = with_groups(rows, stage(told, "told-groups"))
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("row") == F.col("stays"), F.lit(False))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that do not stay: one row of each group is left; its columns are unchanged."""
    row = fresh(docs, "_row")
    full = numbered(docs, "dedup-input", row)
    rows, suspects = exchange(full, text, row)
    stays = keepers(rows, duplicate_groups(full, rows, suspects, text, row))
    go = rows.join(small(stays), "text_sha256").where(F.col("row") != F.col("stays")).select(F.col("row").alias(row))
    return pick_rows(full, row, stage(go, "duplicate-rows"), keep=False).select(*docs.columns)
