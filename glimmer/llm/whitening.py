"""Whitening of embeddings by a covariance that is summed up in tiles.

A vector's entries c become whole numbers x = floor(64 c) + 1000000. The fit list has each distinct x vector once; its
size n and sums S are exact. Its covariance V (divisor n, centred before multiplying) is made of tiles, pairs of column
blocks of ``TILE`` dimensions: rows are cut into row blocks, each row block sends its column blocks to the tiles that need
them, keyed by tile and row block, so that every task multiplies some row blocks of some tiles, adds up what it has of
each tile and passes on one partial tile. Partial tiles are added up in two steps and assembled on the driver, where
dims^2 numbers are decomposed: the size of V depends on the dimensions alone.

Rows whose vector is null, empty or holds null, non-finite or too large entries (x beyond 2^61) take no part, nor do rows
whose vector has another length than most (ties: the longer). Repeated rows count once in the fit list and all get a
result; null ids stay null. Components without variance (at most 1e-12 of the largest) are left out, so a fit list of one
vector, or an empty table, gives no rows. ``deviation`` is null where it passes 64 bits. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import empty_like, prepare, stage

SCALE, SHIFT = 64.0, 1_000_000
#: Dimensions of a column block, and rows of a row block.
TILE, ROWS = 32, 4096
COMPONENTS = 16
#: First-level sums per tile.
SPREAD = 32
#: Greatest size of an entry of x, and least variance of a component against the largest.
LARGEST, LEAST = 2.0**61, 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x of all entries in one array, each vector's length, and which vectors take part."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * c) + SHIFT
        bad = ~(np.abs(x) < LARGEST)  # also what is no number
    edges = np.concatenate(([0], np.cumsum(lengths)))
    wrong = np.concatenate(([0], np.cumsum(bad)))
    good = (wrong[edges[1:]] == wrong[edges[:-1]]) & (lengths > 0)
    return np.where(bad, 0, x).astype(np.int64), lengths, good


def with_whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, dims, x) of the vectors that take part; x: 64-bit numbers as bytes; staged."""
    prepare(vectors.sparkSession)

    def convert(batches):
        for rb in batches:
            x, lengths, good = whole_numbers(rb.column(1))
            data, ends = memoryview(x.astype("<i8", copy=False)).cast("B"), np.cumsum(lengths)
            keep = np.flatnonzero(good)
            bodies = [bytes(data[8 * (ends[i] - lengths[i]) : 8 * ends[i]]) for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(keep)), pa.array(lengths[keep], pa.int32()), pa.array(bodies, pa.binary())], ["vec_id", "dims", "x"])

    thin = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stage(thin.mapInArrow(convert, "vec_id long, dims int, x binary"), "white-rows")
    most = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).select("dims")
    return rows.join(F.broadcast(most), "dims")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column of bytes, one a row."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def sums_of(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension; dims + 1 rows reach the driver."""

    def add(batches):
        n, total = 0, np.zeros(dims, object)
        for rb in batches:
            x = matrix(rb.column(0), dims)
            n += len(x)
            fits = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            total += x.sum(axis=0).astype(object) if fits else x.astype(object).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([n, *map(int, total)], pa.decimal128(38, 0))], ["dim", "total"])

    got = fit.select("x").mapInArrow(add, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    by = {r["dim"]: int(r["total"]) for r in got}
    return by.get(-1, 0), [by.get(k, 0) for k in range(dims)]


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # dims x components, unit columns over the root of their variance
    explained: np.ndarray
    identity_error: float = 0.0

    def __post_init__(self):
        near = [round(Fraction(s, self.n)) for s in self.sums]
        self.near, self.rest = np.array(near, np.int64), np.array([float(Fraction(s, self.n) - k) for s, k in zip(self.sums, near, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        large = max(map(abs, self.sums), default=0)
        if self.n * int(np.abs(x).max(initial=0)) + large < 1 << 62:
            u = self.n * x - np.array(self.sums, np.int64)
            if x.shape[1] * int(np.abs(u).max(initial=0)) ** 2 < 1 << 62:
                return (u * u).sum(axis=1).tolist()
        u = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (u * u).sum(axis=1)]


def tiled_covariance(fit: DataFrame, dims: int, n: int, width: int, values) -> np.ndarray:
    """Covariance of ``values(x)``, centred rows of ``width`` numbers, over the fit list."""
    edges = [(a, min(a + TILE, width)) for a in range(0, width, TILE)]
    tiles = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))]

    def column_blocks(batches):
        first, number, held, rows = TaskContext.get().partitionId() << 32, 0, [], 0

        def sent(x):
            z = values(x)
            parts = [np.ascontiguousarray(z[:, a:b]).tobytes() for a, b in edges]
            own = [(i, j, side, parts[k]) for i, j in tiles for side, k in enumerate((i, j) if i < j else (i,))]
            i, j, side, body = zip(*own, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([first + number] * len(own), pa.int64()), pa.array(side, pa.int32()), pa.array(body, pa.binary())], ["i", "j", "row_block", "side", "body"])

        for rb in batches:
            held.append(matrix(rb.column(0), dims))
            rows += len(held[-1])
            if rows >= ROWS:
                yield sent(np.concatenate(held))
                number, held, rows = number + 1, [], 0
        if rows:
            yield sent(np.concatenate(held))

    def multiply(batches):
        """A task's own part of each tile; it holds one tile, and the left side of one row block."""
        tile, left, total = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([tile[0]], pa.int32()), pa.array([tile[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "j", "part"])
        for rb in batches:
            for i, j, _, side, body in zip(*(rb.column(k).to_pylist() for k in range(5)), strict=True):
                if tile != (i, j):
                    if tile is not None:
                        yield done()
                    tile, total = (i, j), np.zeros((edges[i][1] - edges[i][0], edges[j][1] - edges[j][0]))
                k = j if side else i
                block = np.frombuffer(body).reshape(-1, edges[k][1] - edges[k][0])
                if side == 0:
                    left = block
                if side == 1 or i == j:
                    total += left.T @ block
        if tile is not None:
            yield done()

    def add(key, table):
        total = np.sum([np.frombuffer(x.as_py()) for x in table.column("part")], axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    part = "i int, j int, part binary"
    blocks = fit.select("x").mapInArrow(column_blocks, "i int, j int, row_block long, side int, body binary")
    parts = blocks.repartition("i", "j", "row_block").sortWithinPartitions("i", "j", "row_block", "side").mapInArrow(multiply, part)
    some = parts.groupBy("i", "j", F.pmod(F.xxhash64("part"), F.lit(SPREAD)).alias("k")).applyInArrow(add, part)
    out = np.zeros((width, width))
    for r in some.groupBy("i", "j").applyInArrow(add, part).collect():  # width^2 numbers
        (a, b), (c, d) = edges[r["i"]], edges[r["j"]]
        out[a:b, c:d] = np.frombuffer(r["part"]).reshape(b - a, d - c)
        out[c:d, a:b] = out[a:b, c:d].T
    return out / n


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """From the fit list (x, staged, distinct); None where nothing varies."""
    n, sums = sums_of(fit, dims)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0))
    v = tiled_covariance(fit, dims, n, dims, model.centred)
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    live = (e > 0) & (e > LEAST * max(e[0], 0.0))
    if not live.any():
        return None
    model = Whitening(n, sums, vectors[:, live] / np.sqrt(e[live]), e[live] / np.trace(v))
    # whitened values of the fit list have mean 0 as the centred ones do
    model.identity_error = float(np.abs(tiled_covariance(fit, dims, n, int(live.sum()), model.whitened) - np.eye(int(live.sum()))).max())
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = with_whole_numbers(vectors)
    told = rows.select("dims").limit(1).collect()
    if not told:
        return empty_like(spark, spark.createDataFrame([], OUT).schema)
    dims = told[0]["dims"]
    model = fit_whitening(stage(rows.select("x").distinct(), "white-fit"), dims, components)
    if model is None:
        return empty_like(spark, spark.createDataFrame([], OUT).schema)
    k = len(model.explained)

    def apply(batches):
        for rb in batches:
            x = matrix(rb.column(1), dims)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                rb.column(0).take(at),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(at), model.n), pa.int64()),
                pa.array(model.deviations(x), pa.int64()).take(at),
                pa.array(model.whitened(x).reshape(-1), pa.float64()),
                pa.array(np.tile(model.explained, len(x)), pa.float64()),
                pa.array(np.full(len(at), model.identity_error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(apply, OUT)
