"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in doc_id order, form a stream of text that is cut into blocks of ``block_bytes``; a
document belongs to the block in which it starts. Every slot takes one block. With weight w = q / Q (whole
parts), block j of a source is released at floor(j / w) and due at ceil((j + 1) / w); in each slot the released
block with the earliest deadline goes next (ties: the smaller source name). The weights add up to one, so no
deadline is missed and at any slot each source has had its share to within less than one block.

Windows repeat every Q slots, so one period of the schedule, a table of Q slots that does not grow with the
corpus, places any number of blocks by arithmetic. When a source runs out, the parts of those that remain form
the next phase's weights. Nothing is dropped or repeated. Phases times sources grow with the square of the
sources, so beyond ``PERIODIC_SOURCES`` of them the same schedule is listed block by block.

Null source is the source ''. Null text counts as empty (0 bytes; it starts where the next one starts). Rows that share
source and doc_id move together; null doc_ids come first in their source. Weights: sources missing from a given table get one
part, a source named in it without rows is ignored. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.common import fresh, new_path, prepare, range_staged, small, stage, text_or_empty

BLOCK_BYTES = 1 << 16
#: Parts of the whole for each source there is: the least part of one a source takes at most 1/PARTS of the whole from the others.
PARTS = 1000
#: Up to this many sources a phase's period is repeated by arithmetic; with more, every block's slot is listed.
PERIODIC_SOURCES = 64
#: Listed blocks that the driver holds at once.
LISTED = 1 << 18
LISTED_COLUMNS = ["source", "block", "phase", "slot", "release", "deadline"]


def schedule(parts: dict[str, int]) -> list[str]:
    """One period: the source of each of sum(parts) slots."""
    total = sum(parts.values())
    due = lambda s, j: -(-(j + 1) * total // parts[s])
    waiting = [(0, s, 0) for s in sorted(parts)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), s, j))
        deadline, s, j = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out.append(s)
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * total // parts[s], s, j + 1))
    return out


def phases(blocks: dict[str, int], parts: dict[str, int]) -> list[dict]:
    """Phases until every source has run out: first slot, length, and per source its first block, parts and slots in the period."""
    left, done, base, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        q = {s: parts[s] for s in left}
        g = math.gcd(*q.values())
        q = {s: v // g for s, v in q.items()}
        table, total = schedule(q), sum(q.values())
        at: dict[str, list[int]] = {s: [] for s in q}
        for slot, s in enumerate(table):
            at[s].append(slot)
        length = min((n - 1) // q[s] * total + at[s][(n - 1) % q[s]] + 1 for s, n in left.items())
        out.append({"base": base, "length": length, "total": total, "sources": {s: (done[s], q[s], at[s]) for s in q}})
        for s in q:
            had = length // total * q[s] + int(np.searchsorted(at[s], length % total))
            done[s] += had
            left[s] -= had
        left = {s: n for s, n in left.items() if n > 0}
        base += length
    return out


def listed(blocks: dict, parts: dict) -> Iterator[tuple]:
    """(source, block, phase, slot, release, deadline) of every block by slot: the schedule of ``phases``, listed.

    Sources of equal parts have equal windows, so among them the blocks of one rank go in name order, before those of the
    next rank. Only the next source of each such class waits in a heap, and a new phase costs no pass over the sources.
    """
    left, done, classes = {s: n for s, n in blocks.items() if n > 0}, defaultdict(int), defaultdict(list)
    for s in sorted(left, reverse=True):  # the next in name order is at the end, where removal is cheap
        classes[parts[s]].append(s)
    total, base, phase = sum(parts[s] for s in left), 0, 0
    while left:
        ready, waiting, slot = [(-(-total // q), members[-1], q, 0, 0) for q, members in classes.items()], [], 0
        heapq.heapify(ready)
        while True:
            while waiting and waiting[0][0] <= slot:
                _, q, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // q), classes[q][-1], q, j, 0))
            deadline, s, q, j, at = heapq.heappop(ready)
            if deadline <= slot:
                raise AssertionError("a deadline was missed")
            yield s, done[s], phase, base + slot, base + j * total // q, base + deadline
            slot += 1
            done[s] += 1
            left[s] -= 1
            members = classes[q]
            if not left[s]:
                break
            if at + 1 < len(members):
                heapq.heappush(ready, (deadline, members[-2 - at], q, j, at + 1))
            else:
                heapq.heappush(waiting, ((j + 1) * total // q, q, j + 1))
        del left[s], members[-1 - at]
        if not members:
            del classes[q]
        total, base, phase = total - q, base + slot, phase + 1


def listed_table(spark, names: pa.Array, blocks: dict[int, int], parts: dict[int, int]) -> DataFrame:
    """The listed blocks as a staged table; sources are given by their number in ``names``."""
    path, schema = new_path(spark, "mix-slots"), "source string, block long, phase int, slot long, release long, deadline long"
    rows: list[tuple] = []

    def send():
        cols = np.array(rows, np.int64).reshape(-1, len(LISTED_COLUMNS)).T
        arrays = [names.take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])]
        spark.createDataFrame(pa.table(arrays, names=LISTED_COLUMNS)).withColumn("phase", F.col("phase").cast("int")).write.mode("append").parquet(path)
        rows.clear()

    for row in listed(blocks, parts):
        rows.append(row)
        if len(rows) >= LISTED:
            send()
    if rows:
        send()
    return spark.read.schema(schema).parquet(path)


def tempered(sizes: dict[str, float], power: float = 0.5, parts: int = PARTS) -> dict[str, int]:
    """Whole parts (at least one each) in proportion to size ** power, ``parts`` times the number of sources in all.

    A source's share differs from its target by at most 1/parts of the whole, whatever the number and sizes of the sources.
    """
    raw = {s: max(v, 1.0) ** power for s, v in sizes.items()}
    total = sum(raw.values())
    return {s: max(1, round(parts * len(raw) * v / total)) for s, v in raw.items()}


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per (source, doc_id): n_bytes, first_byte, block, phase, slot, release, deadline (slots of the whole schedule); staged.

    ``slot`` then ``first_byte`` orders the mixture.
    """
    spark = docs.sparkSession
    prepare(spark)
    thin = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    units = thin.groupBy("source", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"))
    units = range_staged(units, ["source", "doc_id"], "mix-units")
    # running bytes: a window inside each part, and what earlier parts of the source hold (at most parts + sources rows)
    held = units.groupBy("part", "source").agg(F.sum("n_bytes").alias("held"))
    whole = Window.partitionBy("source")
    before = held.select("part", "source", (F.sum("held").over(whole.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(whole).alias("size"))
    before = stage(before, "mix-parts")
    w = Window.partitionBy("part", "source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("inside", F.coalesce(F.sum("n_bytes").over(w), F.lit(0))).join(small(before), ["part", "source"])
    last = F.greatest(F.floor((F.col("size") + block_bytes - 1) / block_bytes), F.lit(1)) - 1
    placed = placed.select("source", "doc_id", "n_bytes", (F.col("before") + F.col("inside")).alias("first_byte"), last.alias("last"))
    placed = placed.withColumn("block", F.least(F.floor(F.col("first_byte") / block_bytes), "last").cast("long")).drop("last")
    totals = before.select("source", "size").distinct().orderBy("source").toArrow()  # one row per source, in name order
    names, sizes = totals.column("source").combine_chunks(), totals.column("size").to_pylist()
    blocks = [max(1, -(-n // block_bytes)) for n in sizes]
    if len(sizes) > PERIODIC_SOURCES:
        parts = [max(1, int(weights.get(s, 1))) for s in names.to_pylist()] if weights is not None else list(tempered(dict(enumerate(sizes))).values())
        slots = listed_table(spark, names, dict(enumerate(blocks)), dict(enumerate(parts)))
        placed = placed.join(small(slots), ["source", "block"]).select("source", "doc_id", "n_bytes", "first_byte", "block", "phase", "slot", "release", "deadline")
        return stage(placed, "mixture")
    names = names.to_pylist()
    parts = {s: max(1, int(weights.get(s, 1))) for s in names} if weights is not None else tempered(dict(zip(names, sizes, strict=True)))
    told: dict[str, list[tuple]] = defaultdict(list)
    for k, p in enumerate(phases(dict(zip(names, blocks, strict=True)), parts)):
        for s, (first, q, at) in p["sources"].items():
            told[s].append((k, p["base"], p["total"], first, q, at))
    # one row per source, its phases in an array: a document looks up its own, the last that begins at or before its block
    plan = spark.createDataFrame(list(told.items()), "source string, phases array<struct<phase:int,base:long,total:long,first_block:long,q:long,at:array<int>>>")
    placed = placed.join(F.broadcast(plan), "source")
    own = F.element_at(F.filter("phases", lambda p: p["first_block"] <= F.col("block")), -1)
    placed = placed.select("source", "doc_id", "n_bytes", "first_byte", "block", own.alias("p")).select("source", "doc_id", "n_bytes", "first_byte", "block", "p.*")
    j = F.col("block") - F.col("first_block")
    placed = placed.select(
        "source", "doc_id", "n_bytes", "first_byte", "block", "phase",
        (F.col("base") + F.floor(j / F.col("q")) * F.col("total") + F.get("at", (j % F.col("q")).cast("int"))).cast("long").alias("slot"),
        (F.col("base") + F.floor(j * F.col("total") / F.col("q"))).cast("long").alias("release"),
        (F.col("base") + F.ceil((j + 1) * F.col("total") / F.col("q"))).cast("long").alias("deadline"),
    )
    return stage(placed, "mixture")


def in_mixed_order(docs: DataFrame, weights: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (all rows, same columns) sorted into the mixture; written as Parquet, files and rows keep that order."""
    s, d, slot, at = (fresh(docs, n) for n in ("_s", "_d", "_slot", "_at"))
    order = mix_sources(docs, weights, block_bytes).select(F.col("source").alias(s), F.col("doc_id").alias(d), F.col("slot").alias(slot), F.col("first_byte").alias(at))
    on = (F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col(s)) & docs["doc_id"].cast("long").eqNullSafe(F.col(d))
    return docs.join(small(order), on).orderBy(slot, s, at, d).select(*[docs[c] for c in docs.columns])
