"""Web captures: records from WARC files, and revisits (304 Not Modified) resolved to the response they stand for.

A revisit is resolved to the latest strictly earlier full response of the same canonical URL: an as-of join. Captures
are range-partitioned by (URL, time), so one URL may hold any share of all rows: inside a part the join is a
window, and what a part's first URL inherits from earlier parts is read from one row per part. Then the validators are
checked (entity tag if the revisit has one, else last-modified date), and the stored headers are updated by those
that a 304 may carry over (RFC 9111, 3.2 and 4.3.4).

Results: ``resolved``, ``unvalidated`` (no validator in the revisit), ``mismatch`` (validators differ; headers are the revisit's
own), ``missing`` (no earlier response, or null URL or time). Full responses are returned as ``full``. Of responses at
one time the one with the greatest id counts as latest. Null headers are an empty map; header names are lower-cased. Repeated rows stay. An empty
table gives no rows.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.llm.common import prepare, range_staged, stage
from glimmer.sources.folders import opened

#: Headers that a 304 response never updates (fixed values).
NOT_UPDATED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


#: Bytes of a batch of records, and of a part of a file that is not compressed.
READ_BYTES, PART_BYTES = 16 << 20, 128 << 20
READ_COLUMNS = ["file", "position", "url", "ts", "is_revisit", "status", "etag", "last_modified", "headers", "body"]


def canonical_url(url: Column) -> Column:
    """Scheme, 'www.', default port, fragment, utm_* parameters and closing slashes removed; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.greatest(F.length(bare), F.lit(1)))
    rest = F.regexp_replace(F.regexp_replace(rest, "utm_[a-z]+=[^&]*&?", ""), "[/?&]+$", "")
    return F.concat(F.regexp_replace(F.lower(host), "^www[.]|:(80|443)$", ""), rest)


def lower_names(headers: Column) -> Column:
    """Header names in lower case, since they mean the same in any; of several values that meet, the last in the map stays."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures: capture_id, url, ts (comparable), is_revisit, etag, last_modified, headers map<string,string>.

    Returns capture_id, canonical_url, source_id, status, headers (merged).
    """
    prepare(captures.sparkSession)
    rows = captures.select(
        F.col("capture_id").cast("long").alias("capture_id"), canonical_url(F.col("url")).alias("canonical_url"), "ts", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"),
        "etag", "last_modified", lower_names(F.col("headers")).alias("headers"),
    )
    rows = range_staged(rows, ["canonical_url", "ts"], "captures")
    full = F.when(~F.col("is_revisit") & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.struct("canonical_url", "capture_id", "ts", "etag", "last_modified", "headers"))
    rows = rows.withColumn("full", full)
    # revisits sort before responses of their own time: only strictly earlier ones count
    w = Window.partitionBy("part", "canonical_url").orderBy(F.col("ts").asc_nulls_first(), F.desc("is_revisit"), "capture_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.last("full", ignorenulls=True).over(w))
    edge = rows.groupBy("part").agg(F.min("canonical_url").alias("opens"), F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("canonical_url", "ts", "capture_id"))).alias("held"))
    before, after = edge.select(F.col("part").alias("p"), "held"), edge.select("part", "opens")
    carry = after.join(before, (F.col("p") < F.col("part")) & (F.col("held.canonical_url") == F.col("opens"))).groupBy("part").agg(F.max_by("held", "p").alias("carried"))
    joined = inside.join(F.broadcast(carry), "part", "left")  # at most one row per part
    source = F.coalesce("inside", F.when(F.col("carried.canonical_url") == F.col("canonical_url"), F.col("carried")))
    joined = joined.withColumn("source", F.when(F.col("is_revisit") & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull(), source))
    same = F.when(F.col("etag").isNotNull(), F.coalesce(F.col("etag") == F.col("source.etag"), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("source.last_modified"), F.lit(False)))
    status = F.when(~F.col("is_revisit"), "full").when(F.col("source").isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    news = F.map_filter("headers", lambda k, _: ~k.isin(NOT_UPDATED))
    kept = F.map_filter("source.headers", lambda k, _: ~F.array_contains(F.map_keys(news), k))
    out = joined.withColumn("status", status)
    good = F.col("status").isin("resolved", "unvalidated")
    return out.select("capture_id", "canonical_url", F.when(good, F.col("source.capture_id")).alias("source_id"), "status", F.when(good, F.map_concat(kept, news)).otherwise(F.col("headers")).alias("headers"))


def header_text(headers: Column) -> Column:
    """``name: value`` lines in name order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def head_of(stream: BinaryIO) -> dict[str, str] | None:
    """The fields of the next record, with the stream at its content; None at the end."""
    while (line := stream.readline()) and not line.strip():
        pass
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    return head


def records(stream: BinaryIO, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record that begins before ``end``, one held at a time."""
    while (end is None or stream.tell() < end) and (head := head_of(stream)) is not None:
        yield head, stream.read(int(head.get("content-length", 0)))


def opened_stream(file: str) -> tuple[BinaryIO, bool]:
    """The bytes of a file as they come, and whether it is gzip (whose members are read one after another)."""
    store, path = opened(file)
    raw = io.BufferedReader(store.open_input_file(path), 1 << 20)
    zipped = raw.peek(2)[:2] == b"\x1f\x8b"
    return (io.BufferedReader(gzip.GzipFile(fileobj=raw)) if zipped else raw), zipped


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record of a WARC file at hand; gzip members are read as they come."""
    return records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))


def spans_of(file: str, part_bytes: int) -> Iterator[tuple[str, int, int | None, int]]:
    """(file, begin, end, number of the first record) of parts of about ``part_bytes`` that begin at records.

    Contents are jumped over, so a part never begins at bytes that only look like a record. A gzip file is one part.
    """
    stream, zipped = opened_stream(file)
    with stream:
        if zipped:
            yield file, 0, None, 0
            return
        begin, first, number = 0, 0, 0
        while (head := head_of(stream)) is not None:
            at = stream.seek(int(head.get("content-length", 0)), io.SEEK_CUR)
            number += 1
            if at - begin >= part_bytes:
                yield file, begin, at, first
                begin, first = at, number
        if number > first:
            yield file, begin, None, first


def capture(head: dict[str, str], block: bytes) -> tuple | None:
    """A record as a capture (READ_COLUMNS from the third on); None for what is none."""
    kind = head.get("warc-type")
    if kind not in ("response", "revisit") or (kind == "revisit" and "not-modified" not in head.get("warc-profile", "not-modified")):
        return None
    top, _, body = block.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    http = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}
    code = lines[0].split(" ")[1] if lines[0].count(" ") else ""
    if kind == "response" and not code.startswith("2"):
        return None
    again = kind == "revisit"
    return head.get("warc-target-uri"), head.get("warc-date"), again, int(code) if code.isdigit() else None, http.get("etag"), http.get("last-modified"), http, None if again else body


def read_warc(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Captures of WARC files: file, position, url, ts, is_revisit, status, etag, last_modified, headers, body.

    Files are streamed, so their size has no limit; a record is held whole. One task for each file jumps from record to record
    and cuts it into parts, which are then read by a task each; a gzip file stays in one, member after member. Records go on in
    batches of about ``READ_BYTES``. Full responses are those of status 2xx; of revisits only those that say "not modified".
    Other records are left out. Empty files give no rows; what is no WARC record is an error. Paths as in ``sources.folders``.
    """
    prepare(spark)

    def cut(batches):
        for rb in batches:
            found = [span for file in rb.column(0).to_pylist() for span in spans_of(file, part_bytes)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "begin", "end", "first"])

    def parse(frames):
        for pdf in frames:
            for span in pdf.itertuples():
                out, held = [], 0
                stream, _ = opened_stream(span.file)
                with stream:
                    if span.begin:
                        stream.seek(span.begin)
                    for k, (head, block) in enumerate(records(stream, None if pd.isna(span.end) else int(span.end)), span.first):
                        if (row := capture(head, block)) is not None:
                            out.append((span.file, k, *row))
                            held += len(block)
                        if held >= READ_BYTES:
                            yield pd.DataFrame(out, columns=READ_COLUMNS)
                            out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=READ_COLUMNS)

    files = spark.read.format("binaryFile").load(path).select("path")  # contents are not read here
    spans = stage(files.mapInArrow(cut, "file string, begin long, end long, first long"), "warc-parts")
    each = spans.repartitionByRange(max(1, spans.count()), "file", "begin")
    return each.mapInPandas(parse, "file string, position long, url string, ts string, is_revisit boolean, status int, etag string, last_modified string, headers map<string,string>, body binary")
