"""Packing of token pieces into sequences by minimum bin slack.

A document's ids are cut at multiples of the capacity: full pieces are sequences of their own, the rest of
each document is one shorter piece. Shorter pieces meet in groups of a bounded number of documents; within a
group, each window opens with the longest piece left and is filled with the multiset of remaining lengths
whose sum comes closest to the capacity, found as the highest bit of a subset-sum bitset (one shift per
candidate length, powers of two of each count) and backtracked to counts per length.

Null text is an empty document (its end id alone). Repeated rows and null doc_ids are packed like any other
row; nothing is dropped. Other columns are ignored. An empty table packs to no rows. Sequence ids are unique,
not dense. If a group's last windows cannot be filled, they stay short and are padded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import FILE_BITS, give_back, prepare, stage, text_or_empty, with_file_row
from glimmer.llm.word_ids import CACHE_ENTRIES, batches, encoder

#: Documents whose last pieces are packed together, on average.
GROUP_DOCS = 2048
#: Sequence ids of a group start at group * 2**GROUP_BITS.
GROUP_BITS = 24
PLACED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECES = "doc_id long, bucket long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, bucket, with_ids: bool = False, cache_entries: int = CACHE_ENTRIES, forget: bool = False) -> DataFrame:
    """Pieces of every document; ``bucket``: a long column that names the packing group; ``cache_entries``: words a worker
    remembers; ``forget``: it lets go of them, and of the tokenizer, at the end of each task."""
    prepare(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bucket.cast("long").alias("bucket"), text_or_empty().alias("text"))

    def cut(rows):
        enc = encoder(tokenizer_path, end_id, cache_entries)
        for rb in rows:
            texts = rb.column(2).to_pylist()
            for i, j in batches(texts):
                ids, counts = enc.encode(texts[i:j])
                pieces = -(-counts // capacity)
                of = np.repeat(np.arange(j - i), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(counts[of] - start, capacity)
                edges = np.concatenate(([0], np.cumsum(length)))  # pieces lie one after the other
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                at = pa.array(of + i)
                out = {"doc_id": rb.column(0).take(at), "bucket": rb.column(1).take(at), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(counts[of])}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
            give_back()
        if forget:
            enc = None
            encoder.cache_clear()
            give_back()

    return thin.mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def best_fill(counts: dict[int, int], room: int) -> list[int]:
    """The multiset of lengths (with at most ``counts`` of each) whose sum is closest to ``room`` from below."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left and not reach >> room & 1:  # counts as 1, 2, 4 ... copies at a time
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * take
            total -= length * take
    return out


def fill_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of positions into ``lengths``; every position is in exactly one."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i in reversed(range(len(lengths))):
        by_length[lengths[i]].append(i)
    counts = {k: len(v) for k, v in by_length.items()}
    windows = []
    while counts:
        top = max(counts)
        chosen = [top]
        counts[top] -= 1
        if not counts[top]:
            del counts[top]
        for length in best_fill(counts, capacity - top):
            chosen.append(length)
            counts[length] -= 1
            if not counts[length]:
                del counts[length]
        windows.append([by_length[x].pop() for x in chosen])
    return windows


def pack_pieces(pieces: DataFrame, capacity: int, in_order: bool = False) -> DataFrame:
    """``pieces`` plus sequence_id and offset, packed within each bucket; ``in_order``: written by sequence_id and offset."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pack(key, rows):
        rows = rows.select(PLACED[:5]).sort_by([(c, "ascending") for c in PLACED[:5]])
        seq, off = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        base = key[0].as_py() << GROUP_BITS
        lens = rows.column("length").to_pylist()
        for k, window in enumerate(fill_windows(lens, capacity)):
            at = 0
            for i in window:
                seq[i], off[i] = base + k, at
                at += lens[i]
        placed = rows.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
        return placed.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]) if in_order else placed

    if in_order:  # ranges of buckets satisfy the grouping, which sorts by bucket inside each
        pieces = pieces.repartitionByRange("bucket")
    return pieces.groupBy("bucket").applyInArrow(pack, schema)


def hashed_buckets(docs: DataFrame, group_docs: int = GROUP_DOCS):
    """Bucket column that deals rows evenly by their place in the read, whatever their ids and however often they repeat."""
    n = max(1, -(-docs.select(F.lit(1)).count() // group_docs))
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))


def with_ordered_buckets(docs: DataFrame, name: str, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``docs``, a written Parquet table (read plainly), plus a bucket of consecutive rows: buckets ascend with the table's order."""
    row = F.col(name)
    bucket = F.shiftright(row, FILE_BITS) * F.lit(1 << FILE_BITS - 20) + F.floor(row.bitwiseAND(F.lit((1 << FILE_BITS) - 1)) / group_docs)
    return with_file_row(docs, name).withColumn(name, bucket)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, bucket=None, cache_entries: int = CACHE_ENTRIES, in_order: bool = False, forget: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bucket = hashed_buckets(docs) if bucket is None else bucket
    return pack_pieces(stage(cut_pieces(docs, tokenizer_path, end_id, capacity, bucket, cache_entries=cache_entries, forget=forget), "pieces"), capacity, in_order)


def sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (padded to the capacity except at a power of two), n_tokens."""
    cut = stage(cut_pieces(docs, tokenizer_path, end_id, capacity, hashed_buckets(docs), with_ids=True), "pieces-ids")
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    places = pack_pieces(cut.drop("ids"), capacity)
    texts = cut.groupBy(*key).agg(F.first("ids").alias("ids"))
    cond = [places[k].eqNullSafe(texts[k]) for k in key]
    whole = places.join(texts, cond).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size("ids")
    return whole.select("sequence_id", ids.alias("ids")).select(
        "sequence_id",
        F.when(F.bit_count(n.cast("long")) == 1, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), F.lit(capacity) - n))).alias("ids"),
        n.alias("n_tokens"),
    )
