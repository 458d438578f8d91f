"""Passes over the rows of a key in order, for keys of any size.

Rows are dealt into ranges of (key, order), the parts, which follow one another. A key with many rows covers several parts, so no
window and no task holds a whole key: what a part needs of earlier ones is carried over by a table with one row for each key and
part. Rows that agree in key and all order columns are interchangeable and lie in one part.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glimmer.session import scratch, ship_package

PART = "_part"
#: Rows that a window over numbered rows holds, but for those it looks ahead to.
CHUNK = 4096


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """``df`` written into the shared folder and read back; ``by``: a folder for each of its values."""
    path = scratch(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(rows: DataFrame, key: str, order: list[str], tag: str = "scan") -> DataFrame:
    """``rows`` with PART, the number of their range of (key, order); nulls come first; staged."""
    return staged(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (key, *order)]).withColumn(PART, F.spark_partition_id()), tag)


def _with(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``rows`` and what ``edges`` says of their key and part; rows without an edge go."""
    e = edges.withColumnRenamed(key, "_ek").withColumnRenamed(PART, "_ep")
    return rows.join(e, rows[key].eqNullSafe(e["_ek"]) & (rows[PART] == e["_ep"])).drop("_ek", "_ep")


def per_key(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """``rows`` (in parts) of the keys in ``values`` (one row for each key) with its columns: values are handed to the parts of a key, not to its rows."""
    v = values.withColumnRenamed(key, "_vk")
    edges = rows.select(key, PART).distinct()
    return _with(rows, edges.join(v, edges[key].eqNullSafe(v["_vk"])).drop("_vk"), key)


def _neighbour(rows: DataFrame, key: str, order: list[str], columns: list[str], name: str, ahead: bool) -> DataFrame:
    me, at = F.struct(*columns), F.struct(*order)
    step = F.lead if ahead else F.lag
    inside = step(me).over(Window.partitionBy(PART, key).orderBy(*order))
    edges = rows.groupBy(key, PART).agg((F.min_by if ahead else F.max_by)(me, at).alias("_edge"))
    edges = edges.select(key, PART, step("_edge").over(Window.partitionBy(key).orderBy(PART)).alias("_over"))
    return _with(rows.withColumn("_inside", inside), edges, key).withColumn(name, F.coalesce("_inside", "_over")).drop("_inside", "_over")


def with_previous(rows: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """``rows`` (in parts) with a struct of the columns of the row before, null for a key's first."""
    return _neighbour(rows, key, order, columns, name, False)


def with_next(rows: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """``rows`` (in parts) with a struct of the columns of the row after, null for a key's last."""
    return _neighbour(rows, key, order, columns, name, True)


def with_before(rows: DataFrame, key: str, order: list[str], value: Column, name: str, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """``rows`` (in parts) with the sum (F.sum) or the greatest (F.max) of ``value`` over a key's earlier rows; null where there is none."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    valued = rows.withColumn("_value", value)
    inside = how("_value").over(earlier(Window.partitionBy(PART, key).orderBy(*order)))
    edges = valued.groupBy(key, PART).agg(how("_value").alias("_edge"))
    edges = edges.select(key, PART, how("_edge").over(earlier(Window.partitionBy(key).orderBy(PART))).alias("_over"))
    both = F.greatest("_inside", "_over") if how is F.max else F.coalesce(F.col("_inside") + F.col("_over"), "_inside", "_over")
    return _with(valued.withColumn("_inside", inside), edges, key).withColumn(name, both).drop("_value", "_inside", "_over")


def with_following(rows: DataFrame, key: str, order: list[str], size: int, columns: dict[str, Callable]) -> DataFrame:
    """``rows`` (in parts) with columns over a row and up to ``size`` after it, each made from the window of numbered rows.

    Rows are numbered within their key and cut into chunks; a chunk also gets the ``size`` rows that follow it.
    """
    at = with_before(rows, key, order, F.lit(1), "_at").withColumn("_at", F.coalesce("_at", F.lit(0)))
    chunk = F.floor(F.col("_at") / CHUNK)
    back = F.when((F.col("_at") % CHUNK < size) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    dealt = at.withColumn("_chunk", F.explode(back))
    w = Window.partitionBy(key, "_chunk").orderBy("_at")
    out = dealt.select("*", *[make(w).alias(name) for name, make in columns.items()])
    return out.where(F.col("_chunk") == chunk).drop("_at", "_chunk")


def fold(rows: DataFrame, key: str, order: list[str], columns: list[str], step: Callable, out: T.StructType, tag: str = "fold") -> DataFrame:
    """(key, *out): what ``step`` gives for the rows of each key in order.

    ``step(state, values)`` gets the state after the row before (None at first) and the values of order and columns, and
    returns (state, None or a tuple of out). A state is small: what a later row may depend on, whatever came before.

    Every part streams through one task, which holds a batch and a state. At first each part starts without a state. Then the
    parts whose first key goes on from the part before start again with the state that one ended in, and so on until no
    part's beginning changes. Decisions that depend on the last kept row forget how they began after a few rows, so this
    ends after two or three rounds; at worst, after as many as a key has parts, and the result is the same.
    """
    spark = rows.sparkSession
    ship_package(spark)
    names = [*order, *columns]
    parted = staged(in_parts(rows.select(key, *names), key, order, tag), tag, PART)
    kind = dict(parted.dtypes)[key]
    fields = T.StructType([T.StructField(PART, T.IntegerType()), parted.schema[key], *out.fields, T.StructField("_first", parted.schema[key].dataType), T.StructField("_state", T.BinaryType())])
    arrow, width = to_arrow_schema(fields), len(out.fields)
    ends: dict[int, tuple] = {}  # of each part: first key, last key, the last key's state
    starts: dict[int, bytes | None] = {}  # the state that each part began with
    rounds: list[tuple[DataFrame, list[int]]] = []
    todo: dict[int, bytes | None] | None = None
    while todo is None or todo:
        given = spark.sparkContext.broadcast(todo or {})

        def run(batches, given=given):
            part = first = last = state = None
            for rb in batches:
                made = []
                for p, k, *values in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                    if p != part:
                        if part is not None:
                            made.append((part, last, *[None] * width, first, pickle.dumps(state)))
                        part, first, last, state = p, k, k, None if given.value.get(p) is None else pickle.loads(given.value[p])
                    elif k != last:
                        last, state = k, None
                    state, kept = step(state, tuple(values))
                    if kept is not None:
                        made.append((p, k, *kept, None, None))
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, m, strict=True)) for m in made], arrow)
            if part is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (part, last, *[None] * width, first, pickle.dumps(state)), strict=True))], arrow)

        some = parted if todo is None else parted.where(F.col(PART).isin(list(todo)))
        sort = [F.col(c).asc_nulls_first() for c in (PART, key, *names)]
        result = staged(some.select(PART, key, *names).repartition(PART).sortWithinPartitions(*sort).mapInArrow(run, fields), f"{tag}-round")
        told = result.where(F.col("_state").isNotNull()).select(PART, "_first", key, "_state").collect()  # a row for each part
        ends |= {r[0]: (r[1], r[2], bytes(r[3])) for r in told}
        starts |= {r[0]: (todo or {}).get(r[0]) for r in told}
        rounds.append((result, [r[0] for r in told]))
        todo, line = {}, sorted(ends)
        for before, p in zip(line, line[1:], strict=False):
            state = ends[before][2] if ends[before][1] == ends[p][0] else None
            if state != starts[p]:
                todo[p] = state
    last_round = {p: k for k, (_, parts) in enumerate(rounds) for p in parts}
    found = None
    for k, (result, _) in enumerate(rounds):
        own = result.where(F.col("_state").isNull() & F.col(PART).isin([p for p, r in last_round.items() if r == k]))
        found = own if found is None else found.unionByName(own)
    return found.select(F.col(key).cast(kind).alias(key), *[f.name for f in out.fields])
