"""Shared plumbing: the shared folder, staged tables, size-checked joins, range partitions with carries."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.session import ship_package

#: A side of a join is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 500_000

#: Row numbers that are broadcast at once to pick or drop rows of a table of texts; more go file by file.
PICK_ROWS = 2_000_000

#: Rows of one key that a join leaves together; keys with more are dealt out.
HOT_ROWS = 20_000

#: Rows in an Arrow batch between the JVM and Python: texts are wide, so batches stay at a few MB.
ARROW_ROWS = 1000

#: Row indexes in a file are below 2**FILE_BITS.
FILE_BITS = 40

#: Spark's setting that removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and keep Arrow batches of whole texts small (a smaller setting stays)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one under a local master only."""
    prepare(spark)
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="glimmer-shared-")
    return _own_dirs[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/glimmer/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str, partition_by: list[str] | None = None, codec: str | None = None, path: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost executor costs a re-read.

    Shuffle files of the write are let go when it has ended, since nothing reads them again.
    """
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    if codec:
        w = w.option("compression", codec)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        w.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables; only once all that was derived from them is staged itself."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Hand memory that a Python worker has freed back to the system: workers live on into later stages and would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (counted here), else unchanged so that the join shuffles.

    Pass staged tables only: the count reads their footers.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_spread(many: DataFrame, one: DataFrame, on: list[str], hot: int | None = None, how: str = "inner") -> DataFrame:
    """``many`` joined (inner or left) with ``one`` (a row for each key): keys that more than ``hot`` rows of ``many`` hold are dealt out.

    ``many``: staged, it is read twice. Such keys are at most a ``hot``-th of its rows; ``one`` repeats only theirs.
    """
    hot = HOT_ROWS if hot is None else hot
    parts, salt = fresh(many, "_parts"), fresh(many, "_salt")
    keys = many.groupBy(*on).agg(F.count(F.lit(1)).alias(parts)).where(F.col(parts) > hot).select(*on, F.ceil(F.col(parts) / hot).cast("int").alias(parts))
    keys = stage(keys, "hot-keys")
    if keys.isEmpty():
        return many.join(one, on, how)
    dealt = many.join(small(keys), on, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col(parts)).cast("int"), F.lit(0))).drop(parts)
    each = one.join(small(keys), on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts) - 1, F.lit(0))))).drop(parts)
    return dealt.join(each, [*on, salt], how).drop(salt)


def file_names(docs: DataFrame) -> list[str]:
    """Names of the files that a plain read covers, in the order in which they are numbered."""
    names = sorted((f.rsplit("/", 1)[-1] for f in docs.inputFiles()), key=lambda n: (len(n), n))
    if len(set(names)) < len(names):
        raise ValueError("files of one name in several folders have no order")
    return names


def with_file_row(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, a plain read of Parquet files, plus the place of each row: number of the file in name order * 2^FILE_BITS + row index.

    The numbers come by a broadcast of one row per file, which is what the driver lists for the read itself.
    """
    names = file_names(docs)
    file, number = fresh(docs, "_file"), fresh(docs, "_number")
    known = docs.sparkSession.createDataFrame(pa.table({file: pa.array(names, pa.string()), number: pa.array(range(len(names)), pa.int64())}))
    index = F.col("_metadata.row_index")
    at = docs.select("*", F.col("_metadata.file_name").alias(file), index.alias(name)).join(F.broadcast(known), file, "left")
    sure = F.coalesce(F.col(number), F.raise_error(F.concat(F.lit("not a listed file: "), F.col(file))).cast("long"))
    return at.select(*[docs[c] for c in docs.columns], (sure * F.lit(1 << FILE_BITS) + F.col(name)).alias(name))


def numbered(docs: DataFrame, tag: str, name: str = "row") -> DataFrame:
    """``docs`` plus a number of each row that is the same in every read: its place in its files; staged first if it is no plain read of such."""
    try:
        return with_file_row(docs, name)
    except (AnalysisException, ValueError):
        return with_file_row(stage(docs, tag), name)


def pick_rows(docs: DataFrame, row: str, wanted: DataFrame, keep: bool = True, limit: int | None = None) -> DataFrame:
    """The rows of ``docs`` (from ``numbered``) whose number is in ``wanted`` or, without ``keep``, is not; their texts are not shuffled.

    ``wanted``: staged, its only column is ``row``. Up to ``limit`` numbers are broadcast. Beyond that batches of files are
    read one after another, each with its own numbers only, at most ``limit`` (a file that holds more is a batch), and what is
    picked is staged, so that no more than one batch's numbers are broadcast at a time.
    """
    limit = PICK_ROWS if limit is None else limit
    how = "left_semi" if keep else "left_anti"
    if wanted.limit(limit + 1).count() <= limit:
        return docs.join(F.broadcast(wanted), row, how)
    spark, names = docs.sparkSession, file_names(docs)
    wanted = stage(wanted.repartitionByRange(row).sortWithinPartitions(row), "wanted")  # a batch reads its own range
    number = F.shiftright(row, FILE_BITS)
    held = {r["file"]: r["n"] for r in wanted.groupBy(number.alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per file
    batches: list[list[int]] = []
    total = limit + 1
    for k in range(len(names)):
        total += held.get(k, 0)
        if total > limit:
            batches.append([])
            total = held.get(k, 0)
        batches[-1].append(k)
    path, part = new_path(spark, "picked"), docs
    for b in batches:
        own = wanted.where(F.col(row).between(b[0] << FILE_BITS, (b[-1] + 1 << FILE_BITS) - 1))
        part = docs.where(F.col("_metadata.file_name").isin([names[k] for k in b])).join(F.broadcast(own), row, how)
        part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def range_staged(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """``df`` range-partitioned by ``keys`` and staged, with ``part``: the number of the range partition.

    Every key's rows lie in consecutive parts, so a running value over a key of any size is a window inside
    each part plus a carry over one row per (part, key) at a part's edges.
    """
    out = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    return stage(out.withColumn("part", F.spark_partition_id()), tag)


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
