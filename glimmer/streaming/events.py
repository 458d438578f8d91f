"""Job events as a stream: an append-only log, the state of each job so far, its way through retries and stalls, and segments
written as soon as they are known.

All runs take what is there and end (``availableNow``); the checkpoint of a run lies below its output, so that a later
run goes on where the last one ended and a restart after a failure writes nothing twice. What a run remembers of a job or a segment
lies in Spark's state store; a batch touches the keys that it has rows or timers for and appends what changed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glimmer.session import ship_package

#: Minutes that a job may stay in a status before it counts as stalled (fixed values).
PATIENCE = {"pending": 5, "running": 20}
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 1000) -> DataFrame:
    """Parquet files of events as they arrive below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_at_once)).parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append the stream to a Parquet log, each event once."""
    events.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start().awaitTermination()


def job_states(events: DataFrame, path: str, job: str, at: str, event: str) -> None:
    """Keep per job its last state, event time and number of events: sums in the state store, of which a batch appends those that
    it changed (a folder by the batch's number, so that a repeated batch replaces its own)."""
    sums = events.groupBy(job).agg(F.max_by(event, F.struct(at, event)).alias("state"), F.max(at).alias("at"), F.count(F.lit(1)).alias("n"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    sums.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start().awaitTermination()


def read_states(spark: SparkSession, path: str, job: str) -> DataFrame:
    """The last that was written of each job."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (job, "batch")]
    return rows.groupBy(job).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(job, "s.*")


class JobMachine(StatefulProcessor):
    """One job's way: created -> pending -> running -> completed, back to pending on a failure while attempts are left, else failed;
    stalled when nothing came for longer than its status allows.

    Rows: job, at (milliseconds), event (created, started, failed, completed). A job can be created again once it has ended. Events
    that do not fit the status change nothing. A stall is told at the moment it began, whether the next event shows it or, by an
    event-time timer, the watermark does; so what is told depends on the events alone and not on how they were cut into batches.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, retries int, deadline long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, retries, deadline = self.job.get() or (None, 0, None)
        before, told = deadline, []
        for at, event in sorted((r["at"], r["event"]) for r in rows):
            if deadline is not None and at > deadline:
                status = "stalled"
                told.append((deadline, status, retries))
                deadline = None
            new, retries = self.after(status, retries, event)
            if new != status:
                status, deadline = new, at + PATIENCE[new] * 60_000 if new in PATIENCE else None
                told.append((at, status, retries))
        if deadline != before:
            if before is not None:
                self.handle.deleteTimer(before + 1)
            if deadline is not None:
                self.handle.registerTimer(deadline + 1)
        if told:
            self.job.update((status, retries, deadline))
            yield from self.rows_of(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, retries, deadline = self.job.get()
        if deadline is not None and expiredTimerInfo.getExpiryTimeInMs() == deadline + 1:
            self.job.update(("stalled", retries, None))
            yield from self.rows_of(key, [(deadline, "stalled", retries)])

    def after(self, status: str | None, retries: int, event: str) -> tuple[str | None, int]:
        if event == "created" and status in (None, "completed", "failed"):
            return "pending", 0
        if event == "started" and status in ("pending", "stalled"):
            return "running", retries
        if event == "completed" and status in ("running", "stalled"):
            return "completed", retries
        if event == "failed" and status in ("running", "stalled"):
            return ("pending" if retries + 1 < self.most else "failed"), retries + 1
        return status, retries

    @staticmethod
    def rows_of(key, told) -> Iterator[Row]:
        return (Row(job=key[0], at=at, status=status, retries=retries, n=n) for n, (at, status, retries) in enumerate(told))

    def close(self) -> None:
        pass


def job_transitions(events: DataFrame, path: str, job: str, at: str, event: str, most: int = 3, delay: str = "10 minutes") -> None:
    """Append every change of a job's status to a table: job, at (milliseconds), status, retries, n (place within its batch).

    Null jobs and times take no part. Events may come up to ``delay`` late, as long as those of one job come in order from batch to batch.
    """
    spark = events.sparkSession
    ship_package(spark)
    rows = events.where(F.col(job).isNotNull() & F.col(at).isNotNull()).select(F.col(job).alias("job"), F.col(at).cast("timestamp").alias("_at"), F.col(event).alias("event")).withWatermark("_at", delay)
    rows = rows.withColumn("at", F.floor(F.unix_micros("_at") / 1000))
    out = T.StructType([rows.schema["job"], T.StructField("at", T.LongType()), T.StructField("status", T.StringType()), T.StructField("retries", T.IntegerType()), T.StructField("n", T.IntegerType())])
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # the store that keeps timers
    try:
        told = rows.groupBy("job").transformWithState(JobMachine(most), out, "append", "eventTime")
        told.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)


def last_transitions(transitions: DataFrame) -> DataFrame:
    """Each job's present status: job, at, status, retries."""
    w = Window.partitionBy("job", "at").orderBy("n")  # changes of one job at one moment
    last = transitions.withColumn("n", F.row_number().over(w))
    return last.groupBy("job").agg(F.max(F.struct("at", "n", "status", "retries")).alias("s")).select("job", "s.at", "s.status", "s.retries")


def early_segments(segmented: DataFrame, path: str, key: str, at: str = "at", delay: str = "1 hour") -> None:
    """Append segments (key, start, end, ...) as soon as a video's segmentation arrives, each once.

    What was written is remembered for ``delay`` of the event time ``at``: a segment that is told again within it, in the same batch
    or a later one, is not written again, and the state does not grow with the table.
    """
    good = segmented.where(F.col("end") > F.col("start")).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    once = good.dropDuplicatesWithinWatermark([key, "start", "end"])
    once.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
