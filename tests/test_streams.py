"""Streams in several batches: restarts, retries and stalls by timers, segments that are told twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from glimmer.streaming import events as S

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KIND = "job string, minute double, event string"


def arrive(spark, path, rows):
    """One more file of events."""
    df = spark.createDataFrame([(j, float(m), e) for j, m, e in rows], KIND).withColumn("ts", F.timestamp_micros((F.lit(int(START.timestamp()) * 1_000_000) + F.col("minute") * 60_000_000).cast("long")))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def told(spark, path):
    rows = spark.read.schema("job string, at long, status string, retries int, n int").parquet(path).collect()
    return sorted((r["job"], round(r["at"] / 60_000 - START.timestamp() / 60, 3), r["status"], r["retries"]) for r in rows)


BATCHES = [
    [("a", 0, "created"), ("b", 0, "created"), ("a", 1, "started"), ("c", 0, "started"), ("d", 2, "created")],
    [("a", 2, "failed"), ("a", 3, "started"), ("b", 30, "started"), ("d", 3, "started"), (None, 4, "created")],
    [("a", 4, "failed"), ("a", 5, "started"), ("a", 6, "failed"), ("b", 31, "completed"), ("a", 32, "created")],
    [("e", 300, "created")],
]
WANT = [
    ("a", 0, "pending", 0), ("a", 1, "running", 0), ("a", 2, "pending", 1), ("a", 3, "running", 1), ("a", 4, "pending", 2), ("a", 5, "running", 2), ("a", 6, "failed", 3), ("a", 32, "pending", 0), ("a", 37, "stalled", 0),
    ("b", 0, "pending", 0), ("b", 5, "stalled", 0), ("b", 30, "running", 0), ("b", 31, "completed", 0),
    ("d", 2, "pending", 0), ("d", 3, "running", 0), ("d", 23, "stalled", 0), ("e", 300, "pending", 0),
]


@pytest.mark.parametrize("runs", ["one run, a file a batch", "one batch", "a run for each file"])
def test_jobs_run_retry_fail_and_stall(spark, tmp_path, runs):
    """However the events are cut into batches and runs, the same changes are told, at the time that they happened."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    if runs == "a run for each file":
        for rows in BATCHES:
            schema = arrive(spark, src, rows)
            S.job_transitions(S.event_stream(spark, src, schema, 1), out, "job", "ts", "event", delay="1 hour")
    else:
        for rows in BATCHES:
            schema = arrive(spark, src, rows)
        S.job_transitions(S.event_stream(spark, src, schema, 1 if "file" in runs else 100), out, "job", "ts", "event", delay="1 hour")
        S.job_transitions(S.event_stream(spark, src, schema), out, "job", "ts", "event", delay="1 hour")  # nothing new
    assert told(spark, out) == sorted(WANT)
    rows = spark.read.schema("job string, at long, status string, retries int, n int").parquet(out)
    assert {r["job"]: r["status"] for r in S.last_transitions(rows).collect()} == {"a": "stalled", "b": "completed", "d": "stalled", "e": "pending"}


def test_jobs_are_handled_row_by_row(spark, tmp_path, monkeypatch):
    """A job costs no table of its own: rows go in and out as they are."""
    monkeypatch.setattr("pyspark.sql.GroupedData.transformWithStateInPandas", None)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = arrive(spark, src, BATCHES[0])
    S.job_transitions(S.event_stream(spark, src, schema), out, "job", "ts", "event")
    assert told(spark, out) == [("a", 0, "pending", 0), ("a", 1, "running", 0), ("b", 0, "pending", 0), ("d", 2, "pending", 0)]


def test_states_are_appended_as_they_change(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 0, "x"), ("b", 0, "x"), ("a", 1, "y")], [("a", 2, "z")]):
        schema = arrive(spark, src, rows)
        S.job_states(S.event_stream(spark, src, schema, 1), out, "job", "ts", "event")
    assert {(r["job"], r["state"], r["n"]) for r in S.read_states(spark, out, "job").collect()} == {("a", "z", 3), ("b", "x", 1)}
    assert spark.read.parquet(f"{out}/batch=1").count() == 1  # b did not change


@pytest.mark.parametrize("at_once", [1, 100])
def test_a_segment_is_written_once_over_batches(spark, tmp_path, at_once):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("v", 0.0, 5.0, 0), ("v", 5.0, 9.0, 0), ("w", 0.0, 5.0, 0), ("v", 3.0, 3.0, 0)]
    for late in (0, 10, 20):
        df = spark.createDataFrame([(k, a, b, m + late) for k, a, b, m in rows], "k string, start double, end double, m int").withColumn("at", F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("m") * 60))
        df.coalesce(1).write.mode("append").parquet(src)
    S.early_segments(S.event_stream(spark, src, df.schema, at_once), out, "k")
    S.early_segments(S.event_stream(spark, src, df.schema, at_once), out, "k")
    assert sorted((r["k"], r["start"], r["end"]) for r in spark.read.parquet(out).collect()) == sorted((k, a, b) for k, a, b, _ in rows if b > a)
