"""Time intervals: segmentation, merging, overlap, sampling, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.operators import scans


def overlap_share(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared time over the shorter duration; 0 without overlap or duration."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when((shared > 0) & (shorter > 0), shared / shorter).otherwise(0.0)


def _islands(rows: DataFrame, key: str, order: list[str], gap: float, ratio: float) -> DataFrame:
    """``rows`` with the number of their island within the key."""
    placed = scans.with_previous(scans.in_parts(rows, key, order, "islands"), key, order, ["start", "end"], "_p")
    p_start, p_end = F.col("_p.start"), F.col("_p.end")
    shared = F.least("end", p_end) - F.greatest("start", p_start)
    span = F.greatest("end", p_end) - F.least("start", p_start)
    away = F.col("start") - p_end
    joins = ((shared > 0) & (span > 0) & (shared / F.when(span > 0, span) > ratio)) | ((away >= 0) & (away <= gap))
    flagged = placed.withColumn("_new", F.when(p_end.isNotNull() & F.coalesce(joins, F.lit(False)), 0).otherwise(1)).drop("_p")
    return scans.with_before(flagged, key, order, F.col("_new"), "island").withColumn("island", F.coalesce("island", F.lit(0)) + F.col("_new"))


def merge_segments(segments: DataFrame, key: str, gap: float = 5.0, ratio: float = 0.3, least: float = 2.0, scoring=F.avg) -> DataFrame:
    """Islands of (key, start, end, score): a row joins its predecessor if they overlap by more than ``ratio`` of their
    common span, or follow it within ``gap``. ``scoring``: an aggregate of the scores. Only neighbours in (start, end) order are compared; islands shorter than ``least`` go."""
    placed = _islands(segments.select(key, "start", "end", "score"), key, ["start", "end", "score"], gap, ratio)
    out = placed.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), scoring("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("end") - F.col("start") >= least)


def merge_regions(regions: DataFrame, key: str, slack: float = 1.0) -> DataFrame:
    """Regions (key, start, end, intensity, type) joined when one starts within ``slack`` of the furthest end so far; the greatest
    intensity and its type stay (ties: the first)."""
    order = ["start", "end"]
    rows = scans.in_parts(regions.select(key, "start", "end", "intensity", "type"), key, order, "regions")
    rows = scans.with_before(rows, key, order, F.col("end"), "_reach", F.max)
    flagged = rows.withColumn("_new", F.when(F.col("start") <= F.col("_reach") + slack, 0).otherwise(1)).drop("_reach")
    placed = scans.with_before(flagged, key, order, F.col("_new"), "region").withColumn("region", F.coalesce("region", F.lit(0)) + F.col("_new"))
    best = F.max_by("type", F.struct("intensity", F.negate("start").alias("a"), F.negate("end").alias("b")))
    return placed.groupBy(key, "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("intensity").alias("intensity"), best.alias("type"))


def gaps(regions: DataFrame, key: str, videos: DataFrame, least: float = 2.0) -> DataFrame:
    """Stretches of (key, duration) outside its merged regions that last at least ``least``: before the first region if that begins
    after second 1, between regions, after the last if it ends over a second before the end; all of a video without regions.
    ``videos``: one row for each key."""
    order = ["start", "end"]
    rows = scans.with_next(scans.in_parts(regions.select(key, *order), key, order, "gaps"), key, order, ["start"], "_next")
    between = scans.per_key(rows, key, videos.select(key)).where(F.col("_next").isNotNull()).select(key, F.col("end").cast("double").alias("gap_start"), F.col("_next.start").cast("double").alias("gap_end"))
    edges = regions.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"), F.max(F.struct(*order)).alias("_last"))
    around = videos.select(key, "duration").join(edges, key, "left")
    stretch = lambda a, b, cond: F.when(cond, F.struct(a.cast("double").alias("gap_start"), b.cast("double").alias("gap_end")))
    start, end, d = F.col("_first.start"), F.col("_last.end"), F.col("duration")
    all_of = F.array(stretch(F.lit(0.0), d, start.isNull()), stretch(F.lit(0.0), start, start > 1), stretch(end, d, end < d - 1))
    around = around.select(key, F.explode(F.array_compact(all_of)).alias("g")).select(key, "g.*")
    return between.unionByName(around).where(F.col("gap_end") - F.col("gap_start") >= least)


def _next_cut(window: float):
    def step(last, values):
        (t,) = values
        return (t, (t,)) if last is None or t - last > window else (last, None)

    return step


def merge_near_cuts(cuts: DataFrame, key: str, window: float) -> DataFrame:
    """Rows (key, t), of which one is kept if it lies more than ``window`` after the last kept of its key (the first always is)."""
    rows = cuts.where(F.col("t").isNotNull()).select(key, F.col("t").cast("double").alias("t"))
    return scans.fold(rows, key, ["t"], [], _next_cut(window), T.StructType([T.StructField("t", T.DoubleType())]), "cuts")


def cut_segments(cuts: DataFrame, videos: DataFrame, key: str, overlap: float = 2.0, longest: float = 120.0, least: float = 3.0) -> DataFrame:
    """``segments_from_cuts`` for cuts as rows (key, t) of videos (key, duration): no array of a video's cuts is made."""
    known = videos.select(key, F.col("duration").cast("double").alias("duration"))
    rows = cuts.select(key, F.col("t").cast("double").alias("t"), F.lit(0).alias("_kind")).unionByName(known.select(key, F.explode(F.array(F.lit(0.0), "duration")).alias("t"), F.lit(1).alias("_kind")))
    placed = scans.per_key(scans.in_parts(rows, key, ["t", "_kind"], "cut-edges"), key, known)
    inside = placed.where((F.col("_kind") == 1) | ((F.col("t") > 0) & (F.col("t") < F.col("duration"))))
    spans = scans.with_next(inside, key, ["t", "_kind"], ["t"], "_next").where(F.col("_next").isNotNull())
    return _chunks(spans.select(key, "duration", F.col("t").alias("a"), F.col("_next.t").alias("b")), key, overlap, longest, least)


def _chunks(spans: DataFrame, key: str, overlap: float, longest: float, least: float) -> DataFrame:
    """Spans (key, duration, a, b) widened at inner edges and cut into chunks."""
    wide = spans.select(key, F.when(F.col("a") > 0, F.greatest(F.col("a") - overlap, F.lit(0.0))).otherwise(0.0).alias("a"), F.when(F.col("b") < F.col("duration"), F.least(F.col("b") + overlap, F.col("duration"))).otherwise(F.col("duration")).alias("b"))
    steps = F.sequence(F.lit(0), F.greatest(F.ceil((F.col("b") - F.col("a") - overlap) / (longest - overlap)) - 1, F.lit(0)).cast("int"))
    chunk = wide.select(key, "a", "b", F.explode(steps).alias("_step")).select(key, (F.col("a") + F.col("_step") * (longest - overlap)).alias("start"), F.least(F.col("a") + F.col("_step") * (longest - overlap) + longest, F.col("b")).alias("end"))
    return chunk.where(F.col("end") - F.col("start") >= least)


def merge_cuts(cuts: Column, window: float) -> Column:
    """Sorted times, of which one is kept if it lies more than ``window`` after the last kept (the first always is)."""
    times = F.array_sort(cuts)
    step = lambda kept, t: F.when(t - F.element_at(kept, -1) > window, F.concat(kept, F.array(t))).otherwise(kept)
    return F.when(F.size(times) > 0, F.aggregate(F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, 1), step)).otherwise(times)


def fixed_batches(videos: DataFrame, key: str, duration: str, size: float = 300.0) -> DataFrame:
    """Batches of ``size`` seconds per video, the last one shorter."""
    n = F.ceil(F.col(duration) / size).cast("int")
    rows = videos.where(F.col(duration) > 0).select(key, duration, F.explode(F.sequence(F.lit(0), n - 1)).alias("batch"))
    return rows.select(key, "batch", (F.col("batch") * size).alias("start"), F.least((F.col("batch") + 1) * size, F.col(duration)).alias("end"))


def keyframe_times(batches: DataFrame, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    return batches.select("*", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")).withColumn("at", F.col("start") + F.col("share") * (F.col("end") - F.col("start")))


def segments_from_cuts(videos: DataFrame, key: str, overlap: float = 2.0, longest: float = 120.0, least: float = 3.0) -> DataFrame:
    """Segments of (key, duration, cuts): the stretches between cuts, widened by ``overlap`` at inner edges, in chunks of at
    most ``longest`` that step back by ``overlap``; chunks shorter than ``least`` are left out."""
    edges = F.array_sort(F.concat(F.array(F.lit(0.0), F.col("duration")), F.filter("cuts", lambda c: (c > 0) & (c < F.col("duration")))))
    spans = videos.withColumn("_e", edges).select(key, "duration", F.explode(F.arrays_zip(F.slice("_e", F.lit(1), F.size("_e") - 1).alias("a"), F.slice("_e", F.lit(2), F.size("_e") - 1).alias("b"))).alias("s"))
    return _chunks(spans.select(key, "duration", "s.a", "s.b"), key, overlap, longest, least)


def compare_incremental(new: DataFrame, old: DataFrame, key: str, bucket: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """(new segments with their kind, superseded old segments): joined on ``key`` with the overlap as residual.

    Greatest overlap under 0.8: new, else overlapping; an old segment is superseded by the new one of kind new that overlaps it
    most, over 0.5. Segments meet by key and time bucket: each lies in all buckets that it covers, and a pair counts in the
    first that both cover, so a key with any share of the rows is spread over its time.
    """
    share = overlap_share(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))
    spread = lambda df, a, b: df.withColumn("_k", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket))))
    both = spread(new, "start", "end").join(spread(old, "o_start", "o_end"), [key, "_k"])
    met = both.where((F.col("_k") == F.floor(F.greatest("start", "o_start") / bucket)) & (F.col("start") < F.col("o_end")) & (F.col("end") > F.col("o_start"))).withColumn("share", share)
    best = met.groupBy("id").agg(F.max("share").alias("share"))
    kinds = new.join(best, "id", "left").select("id", F.coalesce("share", F.lit(0.0)).alias("share")).withColumn("kind", F.when(F.col("share") < 0.8, "new").otherwise("overlapping"))
    fresh = kinds.where(F.col("kind") == "new").select("id")
    gone = met.where(F.col("share") > 0.5).join(fresh, "id", "left_semi").groupBy("o_id").agg(F.max(F.struct("share", F.negate("id").alias("n"))).alias("m")).select("o_id", F.negate("m.n").alias("by_id"))
    return kinds, gone


#: One transcript line: [HH:MM:SS.mmm --> HH:MM:SS.mmm] text
LINE = r"\[(\d+):(\d+):(\d+(?:\.\d+)?) --> (\d+):(\d+):(\d+(?:\.\d+)?)\]([^\[]*)"


def parse_transcript(raw: DataFrame, text: str = "raw") -> DataFrame:
    """One row per marked stretch with text: n, start and end in seconds, text (up to the next bracket, over line ends too)."""
    part = lambda g: F.regexp_extract_all(text, F.lit(LINE), F.lit(g))
    rows = raw.select("*", F.posexplode(F.arrays_zip(*[part(g).alias(f"g{g}") for g in range(1, 8)])).alias("n", "z"))
    sec = lambda h, m, s: F.col(f"z.g{h}").cast("double") * 3600 + F.col(f"z.g{m}").cast("double") * 60 + F.col(f"z.g{s}").cast("double")
    return rows.select(*[c for c in raw.columns if c != text], "n", sec(1, 2, 3).alias("start"), sec(4, 5, 6).alias("end"), F.regexp_replace("z.g7", r"^\s+|\s+$", "").alias("text")).where(F.col("text") != "")


def transcript_rows(segments: DataFrame, text: str = "transcription") -> DataFrame:
    """Each segment as one row per parsed transcript line, with the line's own times and text; unchanged where none is found."""
    lines = parse_transcript(segments.select("id", F.col(text).alias("raw"))).select("id", "n", F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("text").alias("_t"))
    out = segments.join(lines, "id", "left")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_a", "start").alias("start"), F.coalesce("_b", "end").alias("end"), F.coalesce("_t", F.col(text)).alias(text))


def clock(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from one hour on."""
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def phase_progress(p0: Column, p1: Column, total: Column) -> Column:
    """struct(phase, percent): phase0 until all are in it, then phase1, then completed; phase1 never beyond phase0."""
    p1 = F.least(p1, p0)
    share = lambda p: F.when(total == 0, 0).otherwise(F.floor(100 * p / F.when(total != 0, total))).cast("long")
    done = (total > 0) & (p1 >= total)
    return F.struct(F.when(done, "completed").when((total > 0) & (p0 >= total), "phase1").otherwise("phase0").alias("phase"), F.when(done, F.lit(100).cast("long")).when((total > 0) & (p0 >= total), share(p1)).otherwise(share(p0)).alias("percent"))


def overall_progress(p0: Column, p1: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(50 * p0 / F.when(total != 0, total) + 50 * p1 / F.when(total != 0, total))).cast("long")


def motion_summary(samples: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Mean and population deviation (each at most 1), peaks over mean + deviation (as they are), static (< 0.1) and action (> 0.6) samples."""
    stats = samples.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    cut = F.col("mean") + F.col("sd")
    return samples.join(stats, key).groupBy(key).agg(F.least(F.lit(1.0), F.first("mean")).alias("mean"), F.least(F.lit(1.0), F.first("sd")).alias("sd"), F.count_if(F.col(value) > cut).alias("peaks"), F.count_if(F.col(value) < 0.1).alias("static"), F.count_if(F.col(value) > 0.6).alias("action"))


def priority(number: Column, duration: Column) -> Column:
    """Later passes first, then shorter segments."""
    return number * 100 + F.greatest(F.lit(0), 20 - duration)


def mark_superseded(old: DataFrame, gone: DataFrame) -> DataFrame:
    """``old`` (id, priority, superseded_by) with the replacement and a low priority where there is one."""
    out = old.join(gone.select(F.col("o_id").alias("id"), F.col("by_id").alias("_by")), "id", "left")
    return out.withColumn("superseded_by", F.coalesce("_by", "superseded_by")).withColumn("priority", F.when(F.col("_by").isNotNull(), 50).otherwise(F.col("priority"))).drop("_by")


def close_frames(frames: DataFrame, key: str, kind: str = "I", within: float = 2.0) -> DataFrame:
    """(key, start, end) of consecutive frames of a kind that lie less than ``within`` apart (frames: t, type, id)."""
    rows = scans.in_parts(frames.select(key, "t", "type", "id"), key, ["t", "id"], "frames")
    both = scans.with_previous(rows, key, ["t", "id"], ["t", "type"], "_p")
    return both.where((F.col("type") == kind) & (F.col("_p.type") == kind) & (F.col("t") - F.col("_p.t") < within)).select(key, F.col("_p.t").alias("start"), F.col("t").alias("end"))


def motion_windows(frames: DataFrame, key: str, size: int = 10, over: float = 0.7) -> DataFrame:
    """(key, start, end, intensity) of windows of ``size`` frames of which more than ``over`` are P frames; a window needs a frame after it."""
    rows = scans.in_parts(frames.select(key, "t", "type", "id"), key, ["t", "id"], "frames")
    made = {
        "intensity": lambda w: F.avg(F.when(F.col("type") == "P", 1.0).otherwise(0.0)).over(w.rowsBetween(0, size - 1)),
        "end": lambda w: F.lead("t", size - 1).over(w),
        "_next": lambda w: F.lead("id", size).over(w),
    }
    out = scans.with_following(rows, key, ["t", "id"], size, made)
    return out.where(F.col("_next").isNotNull() & (F.col("intensity") > over)).select(key, F.col("t").alias("start"), "end", "intensity")


def merged_texts(segments: DataFrame, key: str, gap: float = 5.0, ratio: float = 0.3, least: float = 2.0) -> DataFrame:
    """Islands as in ``merge_segments`` with their texts in order, the best segment's thumbnail, and by score."""
    placed = _islands(segments.select(key, "start", "end", "id", "score", "text", "thumbnail"), key, ["start", "end", "id"], gap, ratio)
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "id", "text")))
    out = placed.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"), parts.alias("p"), F.max_by("thumbnail", F.struct("score", F.negate("start").alias("a"), F.negate("id").alias("k"))).alias("thumbnail"))
    text = F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda t: t.isNotNull() & (t != "")), " ")
    return out.where(F.col("end") - F.col("start") >= least).select(key, "island", "start", "end", "score", text.alias("text"), "thumbnail")
