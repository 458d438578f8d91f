"""Job tables as DataFrames: queues in order, stalls, reconciliation, refinement passes, views, clean-up, and events as a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.operators.keyframes import unit_hash

ACTIVE = ["pending", "running"]


def status_counts(jobs: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    """Total and one count per status for each group, in one pass."""
    return jobs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def queue(jobs: DataFrame, limit: int, most_retries: int = 3) -> DataFrame:
    """The next pending jobs: highest priority, then oldest (ties by id)."""
    return jobs.where((F.col("status") == "pending") & (F.col("retries") < most_retries)).orderBy(F.desc("priority"), "created_at", "id").limit(limit)


def first_pass_first(jobs: DataFrame, limit: int) -> DataFrame:
    """Pending jobs of the first pass, then the others, newest first."""
    return jobs.where(F.col("status") == "pending").orderBy(F.when(F.col("pass") == 1, 0).otherwise(1), F.desc("created_at"), "id").limit(limit)


def due(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Scheduled jobs whose time has come, by that time, the second pass first."""
    return jobs.where((F.col("status") == "scheduled") & (F.col("scheduled_at") <= now)).orderBy("scheduled_at", F.when(F.col("pass") == 2, 0).otherwise(1), "id").limit(limit)


def pending_or_due(jobs: DataFrame, now: Column) -> DataFrame:
    """The oldest job that is pending, or delayed with its time come."""
    return jobs.where((F.col("status") == "pending") | ((F.col("status") == "delayed") & (F.col("scheduled_at") <= now))).orderBy("created_at", "id").limit(1)


def is_stalled(status: Column, created: Column, started: Column, scheduled: Column, now: Column) -> Column:
    """Pending over 5 minutes, running over 20, or scheduled over 10 (times in seconds)."""
    return F.coalesce(((status == "pending") & (now - created > 300)) | ((status == "running") & (now - started > 1200)) | ((status == "scheduled") & (now - scheduled > 600)), F.lit(False))


def reset_stalled(jobs: DataFrame, now: Column) -> DataFrame:
    """Stalled jobs are pending again, without a start time."""
    bad = is_stalled(F.col("status"), F.col("created_at"), F.col("started_at"), F.col("scheduled_at"), now)
    return jobs.withColumns({"status": F.when(bad, "pending").otherwise(F.col("status")), "started_at": F.when(~bad, F.col("started_at"))})


def reconcile(jobs: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """(kind, id): what a reconciliation has to do: jobs to reset, and items that no pending, running or completed job covers."""
    bad = is_stalled(F.col("status"), F.col("created_at"), F.col("started_at"), F.col("scheduled_at"), now)
    covered = jobs.where(F.col("status").isin(*ACTIVE, "completed")).select("path")
    return jobs.where(bad).select(F.lit("reset").alias("kind"), "id").unionByName(items.join(covered, "path", "left_anti").select(F.lit("enqueue").alias("kind"), "id"))


def create_jobs(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """(path, pass, id, created): a wanted job takes the id of an active one for its path and pass (the smallest), else a new id from both."""
    live = jobs.where(F.col("status").isin(ACTIVE)).groupBy("path", "pass").agg(F.min("id").cast("string").alias("old"))
    out = wanted.select("path", "pass").distinct().join(live, ["path", "pass"], "left")
    return out.select("path", "pass", F.coalesce("old", F.substring(F.sha2(F.concat_ws("|", "path", "pass"), 256), 1, 32)).alias("id"), F.col("old").isNull().alias("created"))


def schedule_passes(jobs: DataFrame, passes: list[tuple[int, float, int]], now: Column, jitter: float = 0.2) -> DataFrame:
    """A job for every later pass (number, threshold, delay in seconds) of each completed first pass; the delay varies by
    up to ``jitter`` either way, by a hash of path and pass, so that a rerun plans the same times."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pass"), F.lit(t).alias("threshold"), F.lit(d).alias("delay")) for n, t, d in passes if n > 1]))
    out = jobs.where((F.col("status") == "completed") & (F.col("pass") == 1)).select("path", each.alias("p")).select("path", "p.*")
    share = unit_hash(F.col("path"), F.col("pass").cast("string"))
    return out.select("path", "pass", "threshold", (now + F.col("delay") * (1 - jitter + 2 * jitter * share)).alias("scheduled_at"))


def gate(parent_status: Column, duration: Column, segments: Column) -> Column:
    """Whether a pass may run: its parent is done, the video lasts a minute or more, and it has at most 20 segments."""
    return F.coalesce((parent_status == "completed") & (duration >= 60) & (segments <= 20), F.lit(False))


def coarse_and_fine(jobs: DataFrame, now: Column) -> DataFrame:
    """The next five coarse jobs and the next three fine ones that have waited for 15 minutes, oldest first."""
    live = jobs.where((F.col("status") == "pending") & ((F.col("mode") == "coarse") | (F.col("created_at") <= now - 900)))
    w = Window.partitionBy("mode").orderBy("created_at", "id")
    return live.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.when(F.col("mode") == "coarse", 5).otherwise(3))


def active_view(scans: DataFrame, jobs: DataFrame) -> DataFrame:
    """Running scans, and one row per source with open work: kind, id, total, completed, failed, progress."""
    own = scans.where(F.col("status") == "running").select(F.lit("scan").alias("kind"), F.col("id").cast("string").alias("id"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("completed"), F.lit(None).cast("long").alias("failed"), F.col("progress").cast("long").alias("progress"))
    by = jobs.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"))
    by = by.where((F.col("pending") > 0) | (F.col("completed") + F.col("failed") < F.col("total")))
    return own.unionByName(by.select(F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("id"), "total", "completed", "failed", F.floor(100 * F.col("completed") / F.col("total")).cast("long").alias("progress")))


def first_of(key: str, *lists: DataFrame) -> DataFrame:
    """Union of job lists; of rows with one key the first list's stays (within a list the one whose columns sort first)."""
    cols = lists[0].columns
    marked = reduce(DataFrame.unionByName, [x.withColumn("_from", F.lit(i)) for i, x in enumerate(lists)])
    return marked.groupBy(key).agg(F.min(F.struct("_from", *[c for c in cols if c != key])).alias("m")).select(*[F.col(key) if c == key else F.col(f"m.{c}").alias(c) for c in cols])


def job_title(status: Column, progress: Column, message: Column, path: Column, phase: Column) -> Column:
    """struct(title, operation, description) of a video job; the stored message before the progress cuts at 30 and 70 (the texts are fixed values)."""
    name = F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit("video"))
    waits, runs, said = status.isin("scheduled", "pending"), status.isin("running", "processing"), F.coalesce(message, F.lit("")) != ""
    steps = lambda a, b, c: F.when(progress < 30, a).when(progress < 70, b).otherwise(c)
    title = F.when(waits, "Queued").when(runs & said, message).when(runs, steps("Extracting Video Segments", "Generating Transcriptions", "Creating Keyframes")).when(status == "completed", "Video Processing Complete")
    kind = F.when(waits, "video_queue").when(runs & said, F.when(phase == "phase0", "video_segmentation").otherwise("video_keyframes")).when(runs, steps("video_segmentation", "video_transcription", "video_keyframes")).when(status == "completed", "video_complete")
    lead = F.when(waits, "Queued for video processing: ").when(runs & said, "Processing ").when(runs, steps("Extracting segments from ", "Creating transcriptions for ", "Generating keyframes for ")).when(status == "completed", "Completed processing ")
    return F.struct(title.alias("title"), kind.alias("operation"), F.concat(lead, name).alias("description"))


def orphans(items: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, id): items whose file is gone, and sources that no remaining item has."""
    gone = items.join(files.select("path"), "path", "left_anti")
    left = items.join(files.select("path"), "path", "left_semi")
    return gone.select(F.lit("item").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(sources.join(left.select("source_id"), "source_id", "left_anti").select(F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("id")))


def phase_metrics(jobs: DataFrame, video: str | None = None, number: int | None = None) -> DataFrame:
    """Refinement metrics, filtered where a filter is given, newest first."""
    if video is not None:
        jobs = jobs.where(F.col("path") == video)
    if number is not None:
        jobs = jobs.where(F.col("pass") == number)
    return jobs.orderBy(F.desc("created_at"), "id")


def listed(jobs: DataFrame, statuses: list[str], limit: int) -> DataFrame:
    """The oldest jobs in any of the statuses (ties by id)."""
    return jobs.where(F.col("status").isin(statuses)).orderBy("created_at", "id").limit(limit)


def status_of_paths(jobs: DataFrame) -> DataFrame:
    """Per path its newest job (ties: the larger id) with its status, how many jobs it has had, and whether one is active."""
    out = jobs.groupBy("path").agg(F.max_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("j"), F.count(F.lit(1)).alias("n"), F.max(F.col("status").isin(ACTIVE)).alias("active"))
    return out.select("path", "j.id", "j.status", "n", F.coalesce("active", F.lit(False)).alias("active"))
