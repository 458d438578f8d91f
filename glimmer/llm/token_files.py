"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

Documents are range-partitioned by doc_id, encoded, and written as blocks: one row per block in a Parquet
table in the shared folder, whose ``data`` holds the block in this binary layout (little endian)::

    magic "GTK1" | id width (2 or 4) | n_docs u32 | n_null u32 | n_ids u64
    Elias-Fano(document ids - first id, for ids that are not null) preceded by the first id (i64)
    Elias-Fano(document ends in the block's ids)
    ids (n_ids x width)

Elias-Fano keeps the low bits of each value packed and the high bits as a unary bit vector; every 64th one
has its position sampled, so ``select`` finds any boundary without a table of 64-bit offsets. ``read_documents``
reads single documents so: the blocks that hold them, and two boundaries of each.

Null doc_ids come first; repeated doc_ids stay, next to each other, by the first 64 characters of their texts and
then as they stand in the files, so that one id (or null) with any share of all rows is split over range partitions. A null
text is an empty document (the end id alone); an empty table writes no block and reads back as no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.llm.common import new_path, numbered, prepare, text_or_empty
from glimmer.llm.word_ids import batches, encoder

MAGIC = b"GTK1"
SAMPLE = 64
#: A block is closed at this many ids, or at this many documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 14


class EliasFano:
    """Non-decreasing integers from 0 in about 2 + log2(max / n) bits each."""

    HEAD = struct.Struct("<IQBII")  # n, universe, low bits, bytes of high part, samples

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.universe, self.low_bits, len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The structure and the number of bytes it takes."""
        n, universe, low_bits, n_high, n_samples = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        low = np.frombuffer(data, np.uint8, (n * low_bits + 7) // 8, at)
        at += len(low)
        high = np.frombuffer(data, np.uint8, n_high, at)
        at += n_high
        samples = np.frombuffer(data, "<u4", n_samples, at)
        return cls(n, universe, low_bits, low, high, samples), at + 4 * n_samples

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i`` alone: from the sample before each, over at most 64 ones; all walk side by side."""
        i = np.asarray(i, np.int64)
        if i.size and not (0 <= i.min() and i.max() < self.n):
            raise IndexError
        start = self.samples[i // SAMPLE].astype(np.int64)
        left, byte = i % SAMPLE, start // 8
        word = self.high[byte] & (0xFF << (start % 8) & 0xFF).astype(np.uint8)
        go = np.arange(i.size)
        while go.size:  # whole bytes
            ones = np.bitwise_count(word[go])
            go, ones = go[ones <= left[go]], ones[ones <= left[go]]
            left[go] -= ones
            byte[go] += 1
            word[go] = self.high[byte[go]]
        go = np.flatnonzero(left)
        while go.size:  # ones inside the last byte
            word[go] &= word[go] - np.uint8(1)
            left[go] -= 1
            go = go[left[go] > 0]
        last = np.bitwise_count((word & (~word + np.uint8(1))) - np.uint8(1)).astype(np.int64)
        value = (byte * 8 + last - i) << self.low_bits
        first = i * self.low_bits
        for k in range(self.low_bits):
            value |= (self.low[(first + k) // 8] >> ((first + k) % 8).astype(np.uint8) & 1).astype(np.int64) << k
        return value


def encode_block(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """One block; doc_ids ascending, nulls first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    first = int(known[0]) if len(known) else 0
    head = MAGIC + struct.pack("<BIIQq", width, len(doc_ids), len(doc_ids) - len(known), len(ids), first)
    spread = (known.astype(np.uint64) - np.uint64(first % (1 << 64))) if len(known) else known
    return head + EliasFano.build(spread).to_bytes() + EliasFano.build(np.cumsum(counts)).to_bytes() + ids.astype(f"<u{width}").tobytes()


class Block:
    """A block as it lies in ``data``: nothing is decoded until it is asked for."""

    def __init__(self, data: bytes | pa.Buffer):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a token block")
        width, self.n_docs, self.n_null, n_ids, self.first = struct.unpack_from("<BIIQq", view, 4)
        at = 4 + struct.calcsize("<BIIQq")
        self.known, used = EliasFano.from_bytes(view[at:])
        at += used
        self.ends, used = EliasFano.from_bytes(view[at:])
        self.ids = np.frombuffer(view, f"<u{width}", n_ids, at + used)

    def doc_ids(self, places: np.ndarray) -> list[int | None]:
        named = places[places >= self.n_null] - self.n_null
        values = iter((self.known.select(named) + self.first).tolist())
        return [None if p < self.n_null else next(values) for p in places.tolist()]

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents at ``places`` begin and end."""
        begins = np.zeros(len(places), np.int64)
        begins[places > 0] = self.ends.select(places[places > 0] - 1)
        return begins, self.ends.select(places)


BLOCKS = "part int, block int, local_start long, n_docs int, n_ids long, data binary"
READ_SCHEMA = "number long, doc_id long, start long, n_tokens long, ids array<long>"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encode ``docs`` (doc_id, text) and write the block table to ``path`` in ascending doc_id order."""
    prepare(docs.sparkSession)
    thin = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), "token-input", "place")
    by = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.col("place")]
    ordered = thin.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def write(rows):
        enc, part, block, start = encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0, 0
        names, parts, counts, held = [], [], [], 0

        def flush():
            nonlocal names, parts, counts, held, block, start
            ids = np.concatenate(parts)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(names)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([encode_block(names, ids, np.concatenate(counts))], pa.binary())],
                ["part", "block", "local_start", "n_docs", "n_ids", "data"],
            )
            block, start = block + 1, start + len(ids)
            names, parts, counts, held = [], [], [], 0
            return out

        for rb in rows:
            doc_ids, texts = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            for i, j in batches(texts):
                ids, n = enc.encode(texts[i:j])
                names += doc_ids[i:j]
                parts.append(ids)
                counts.append(n)
                held += len(ids)
                if held >= BLOCK_IDS or len(names) >= BLOCK_DOCS:
                    yield flush()
        if names:
            yield flush()

    ordered.mapInArrow(write, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with_ids adds the ids."""
    prepare(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row per part (at most as many as the write had partitions), so one window and a broadcast serve any corpus
    base = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    placed = blocks.join(F.broadcast(base), "part").select((F.col("base") + F.col("local_start")).alias("first"), "data")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(rows):
        for rb in rows:
            for first, data in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                held = Block(data.as_buffer())
                every, ids = np.arange(held.n_docs), held.ids
                doc_ids, ends = held.doc_ids(every), held.ends.select(every)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(first + starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return placed.mapInArrow(read, schema)


def read_documents(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The documents at these places in the order of the files (from 0): number, doc_id, start, n_tokens, ids.

    Places that no document has give no row; a repeated one gives one. Only blocks that hold one of them are opened.
    """
    prepare(spark)
    if not numbers:
        return spark.createDataFrame([], READ_SCHEMA)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    before = Window.orderBy("part")  # one row per part
    parts = blocks.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum("n_ids").alias("ids"))
    base = parts.select("part", (F.sum("docs").over(before) - F.col("docs")).alias("docs"), (F.sum("ids").over(before) - F.col("ids")).alias("ids"))
    inside = F.sum("n_docs").over(Window.partitionBy("part").orderBy("block")) - F.col("n_docs")
    spans = blocks.select("part", "block", "local_start", "n_docs", inside.alias("inside")).join(F.broadcast(base), "part")
    spans = spans.select("part", "block", (F.col("docs") + F.col("inside")).alias("low"), "n_docs", (F.col("ids") + F.col("local_start")).alias("first"))
    asked = spark.createDataFrame(pa.table({"number": pa.array(sorted(set(numbers)), pa.int64())}))
    met = spans.join(F.broadcast(asked), (F.col("number") >= F.col("low")) & (F.col("number") < F.col("low") + F.col("n_docs")))
    wanted = met.groupBy("part", "block").agg(F.min("low").alias("low"), F.min("first").alias("first"), F.array_sort(F.collect_list("number")).alias("numbers"))  # of the caller's list
    found = blocks.select("part", "block", "data").join(F.broadcast(wanted), ["part", "block"]).select("low", "first", "numbers", "data")

    def read(rows):
        for rb in rows:
            for low, first, asked, data in zip(*(rb.column(k).to_pylist() for k in range(3)), rb.column(3), strict=True):
                held, places = Block(data.as_buffer()), np.array(asked, np.int64) - low
                begins, ends = held.bounds(places)
                texts = [held.ids[a:b].astype(np.int64) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(asked, pa.int64()), pa.array(held.doc_ids(places), pa.int64()), pa.array(first + begins), pa.array(ends - begins), pa.array(texts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["number", "doc_id", "start", "n_tokens", "ids"])

    return found.mapInArrow(read, READ_SCHEMA)


def token_file_index(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the files into the shared folder and return what they hold, per document."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(docs, tokenizer_path, end_id, path)
    return read_token_files(spark, path)
