"""Cuts, keyframes and frames: thresholds, sampling times, selection by score, perceptual hashes, greedy passes over a video.

The greedy passes go over a video's samples in time order, since a decision depends on the last one kept; a video of any length is
spread over ranges of its time (``scans.fold``). Times that the plain rule jitters at random are jittered by a hash here, so that a
rerun gives the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.operators import scans

#: How a technique scales the scene threshold: factor and least value (fixed values).
TECHNIQUES = {"basic_scene": (1.0, 0.0), "motion_analysis": (0.7, 0.0), "histogram_analysis": (0.75, 0.05), "edge_detection": (0.8, 0.0)}
#: Most candidates of a pass by its priority (fixed values).
MOST = {"immediate": 5, "delayed": 10, "background": 20}


TIMES = T.StructType([T.StructField("t", T.DoubleType())])


def scene_cuts(samples: DataFrame, key: str, threshold: float, techniques: list[str]) -> DataFrame:
    """Distinct (key, t) whose scene score exceeds the threshold as any of the techniques scales it."""
    cuts = [samples.where(F.col("scene") > max(least, threshold * factor)).select(key, "t") for factor, least in (TECHNIQUES[t] for t in techniques)]
    return reduce(DataFrame.unionByName, cuts).distinct()


def unit_hash(*parts: Column) -> Column:
    """0 .. 1 by a hash of the parts, one that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") % 1000 / 999.0


def fallback_cuts(videos: DataFrame, key: str, duration: str, every: float = 15.0, jitter: float = 0.1) -> DataFrame:
    """A cut every ``every`` seconds inside a video, moved by up to ``jitter`` of that either way."""
    n = F.ceil(F.col(duration) / every).cast("int") - 1
    rows = videos.where(n >= 1).select(key, duration, F.explode(F.sequence(F.lit(1), n)).alias("n"))
    t = F.col("n") * every + (unit_hash(F.col(key).cast("string"), F.col("n").cast("string")) * 2 - 1) * every * jitter
    return rows.select(key, "n", F.greatest(F.lit(0.0), F.least(F.col(duration), t)).alias("t"))


def frame_score(motion: Column, histogram: Column, complexity: Column) -> Column:
    return motion * 0.3 + histogram * 0.4 + complexity * 0.3


def greedy_keyframes(samples: DataFrame, key: str, longest: float = 8.0, shortest: float = 0.5, least: float = 0.2, most: int = 20) -> DataFrame:
    """(key, t) kept from samples (key, t, motion, histogram, complexity) in time order: always ``longest`` after the last, never
    within ``shortest``, else by score (half as much again where complexity exceeds 0.7). Once a kept one fills the ``most``, only the
    forced branch went on before; if none is kept, the best sample is (the first of equal ones)."""
    s = frame_score(F.col("motion"), F.col("histogram"), F.col("complexity"))
    rows = samples.select(key, F.col("t").cast("double").alias("t"), s.alias("s"), F.when(F.col("complexity") > 0.7, s * 1.5).otherwise(s).alias("b"))

    def step(state, values):
        """State: time of the last kept one, how many were kept, whether that is enough."""
        last, n, full = state or (None, 0, False)
        t, _, boosted = values
        if full or t is None:
            return state, None
        force = last is None or t - last >= longest
        scored = not force and t - last >= shortest
        keep = force or (scored and boosted is not None and boosted >= least)
        n += keep
        if scored and n >= most:  # the limit is looked at after scored samples only
            return (None, 0, True), (t,) if keep else None
        return ((t, n, False), (t,)) if keep else ((last, n, False), None)

    return scans.fold(rows, key, ["t", "s", "b"], [], step, TIMES, "keyframes")


def adaptive_threshold(motion: Column) -> Column:
    return F.when(motion > 0.7, 0.3).when(motion > 0.4, 0.4).when(motion > 0.2, 0.5).otherwise(0.6)


def needs_fallback(motion: Column, cuts: Column) -> Column:
    """Motion without a cut."""
    return (cuts == 0) & (motion > 0.2)


def weighted_times(peaks: Column, start: Column, end: Column, most: int, name: Column) -> Column:
    """The first peaks inside the segment, else evenly placed times, moved a little by a hash of the name."""
    inside = F.slice(F.filter(F.coalesce(peaks, F.array().cast("array<double>")), lambda p: (p >= start) & (p <= end)), 1, most)
    step = (end - start) / (most + 1)
    even = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.greatest(start, F.least(end, start + step * i + (unit_hash(name.cast("string"), i.cast("string")) - 0.5) * F.least(F.lit(1.0), step * 0.1))))
    return F.when(F.size(inside) > 0, inside).otherwise(even)


def thresholds(motion: Column, complexity: Column, cuts_per_minute: Column, duration: Column) -> Column:
    """struct(scene, motion, sharpness, most) of the fine pass."""
    scene = F.when(cuts_per_minute > 2, 0.3).otherwise(0.5) - motion * 0.2 + F.when(complexity > 0.7, 0.1).otherwise(-0.1)
    return F.struct(F.greatest(F.lit(0.2), F.least(F.lit(0.7), scene)).alias("scene"), (motion * 0.8).alias("motion"), F.when(complexity > 0.5, 0.4).otherwise(0.2).alias("sharpness"), F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(duration / 3))).cast("int").alias("most"))


def segment_kind(near_region: Column, motion: Column, complexity: Column) -> Column:
    return F.when(near_region, "transition").when(motion < 0.1, "static").when((motion > 0.4) & (complexity > 0.3), "action").otherwise("dialogue")


def target_count(kind: Column, duration: Column, most: Column) -> Column:
    share = lambda cap, each: F.least(F.lit(cap), F.ceil(duration / each).cast("int"))
    n = F.when(kind == "static", 1).when(kind == "dialogue", share(2, 8)).when(kind == "action", share(5, 3)).when(kind == "transition", share(3, 4)).otherwise(1)
    return F.greatest(F.lit(1), F.least(most, n))


def coarse_stats(regions: DataFrame, key: str, minutes: str) -> DataFrame:
    """Per video: mean intensity of motion and histogram regions (at most 1; 0 without any) and regions per minute (a minute at least)."""
    mean = lambda kind: F.least(F.lit(1.0), F.coalesce(F.avg(F.when(F.col("type") == kind, F.col("intensity"))), F.lit(0.0)))
    return regions.groupBy(key).agg(mean("motion_spike").alias("motion"), mean("histogram_shift").alias("complexity"), (F.count(F.lit(1)) / F.greatest(F.lit(1.0), F.max(minutes))).alias("cuts_per_minute"))


def weighted_scores(scores: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, sample, score): techniques' scores by weight; a technique without a sample counts 0 there."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("technique")], F.lit(0.0))
    return scores.groupBy(key, "sample").agg(F.sum(F.coalesce("score", F.lit(0.0)) * w).alias("score"))


def top_share(candidates: DataFrame, key: str, duration: str, priority: str) -> DataFrame:
    """The best quarter of a segment's candidates, or two fifths, or one per three seconds, or all: the first that is enough; at most what the priority allows."""
    sizes = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = candidates.withColumn("_down", F.negate("score"))
    rows = scans.in_parts(rows, key, ["_down", "sample"], "top-share")
    rows = scans.with_before(rows, key, ["_down", "sample"], F.lit(1), "_before").withColumn("rn", F.coalesce("_before", F.lit(0)) + 1)
    n, least = F.col("_n"), F.greatest(F.lit(1), F.ceil(F.col(duration) / 3))
    quarter, more = F.greatest(F.lit(1), F.ceil(n * 0.25)), F.greatest(F.lit(1), F.ceil(n * 0.4))
    take = F.when(quarter >= least, quarter).when(more >= least, more).when(n >= least, least).otherwise(n)
    return scans.per_key(rows, key, sizes).where(F.col("rn") <= F.least(take, F.lit(MOST.get(priority, 5)))).select(*candidates.columns, "rn")


def cut_offs(rows: DataFrame, key: str, score: str) -> DataFrame:
    """Per group the scores at 20 and 30 per cent from the top."""
    return ranked_values(rows, key, score, {"p80": 0.2, "p70": 0.3})


def ranked_values(rows: DataFrame, key: str, score: str, shares: dict[str, float]) -> DataFrame:
    """Per group the value at each share from the top (of n values the one at place floor(n * share) + 1, the last at most).

    Equal values are counted before anything is put in order, and places are sums carried over ranges of the values, so no
    task holds a group.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(key, F.negate(score).alias("_down")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(key).agg(F.sum("_c").alias("_n"))
    placed = scans.with_before(scans.in_parts(counts, key, ["_down"], "values"), key, ["_down"], F.col("_c"), "_before")
    placed = scans.per_key(placed.withColumn("_before", F.coalesce("_before", F.lit(0))), key, sizes)
    at = lambda share: F.least(F.col("_n"), F.floor(F.col("_n") * share) + 1)
    here = lambda share: (F.col("_before") < at(share)) & (at(share) <= F.col("_before") + F.col("_c"))
    return placed.groupBy(key).agg(*[F.max(F.when(here(share), F.negate("_down"))).alias(name) for name, share in shares.items()])


def bits_hex(bits: Column) -> Column:
    """64 bits ('0'/'1') as 16 hex digits."""
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def p_hash(pixels: Column) -> Column:
    """64 grey values: above their mean or not."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / 64.0
    return bits_hex(F.array_join(F.transform(pixels, lambda x: F.when(x > mean, "1").otherwise("0")), ""))


def d_hash(pixels: Column) -> Column:
    """9 x 8 grey values, row by row: each against its right neighbour."""
    spots = F.filter(F.sequence(F.lit(0), F.lit(70)), lambda i: i % 9 != 8)
    return bits_hex(F.array_join(F.transform(spots, lambda i: F.when(F.get(pixels, i) > F.get(pixels, i + 1), "1").otherwise("0")), ""))


def hex_distance(a: Column, b: Column) -> Column:
    """Share of hex digits that differ; 1 for different lengths."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(a) != F.length(b), 1.0).otherwise(differ / F.length(a))


def differing(a: str, b: str) -> int:
    """Digits in which two hashes of one length differ."""
    return sum(x != y for x, y in zip(a, b, strict=True))


def digit_share(a: str, b: str) -> float:
    """``hex_distance`` of two values."""
    return 1.0 if len(a) != len(b) else differing(a, b) / max(1, len(a))


def _fold_frames(frames: DataFrame, key: str, keep) -> DataFrame:
    """(key, t) of each video's first frame and of those that ``keep(frame, last kept frame)`` keeps; frames: (p_hash, d_hash, near)."""

    def step(last, values):
        t, *frame = values
        return (frame, (t,)) if last is None or keep(frame, last) else (last, None)

    rows = frames.select(key, F.col("t").cast("double").alias("t"), "p_hash", "d_hash", "near")
    return scans.fold(rows, key, ["t", "p_hash", "d_hash", "near"], [], step, TIMES, "distinct-frames")


def distinct_frames(frames: DataFrame, key: str, least: float = 0.15) -> DataFrame:
    """(key, t) of frames (t, p_hash, d_hash, near a scene boundary) that differ from the last kept one: 0.7 p + 0.3 d over ``least``,
    d over 0.2, or near. A frame without both hashes is kept only where it is near, and then compares with none but by that."""

    def keep(x, last):
        if x[2]:
            return True
        if None in (x[0], x[1], last[0], last[1]):
            return False
        d = digit_share(x[1], last[1])
        return digit_share(x[0], last[0]) * 0.7 + d * 0.3 > least or d > 0.2

    return _fold_frames(frames, key, keep)


def distinct_frames_by_digits(frames: DataFrame, key: str, least: int = 5, p_only: bool = False) -> DataFrame:
    """The same with counts of differing hex digits: the smaller of both (or p alone) over ``least``; a missing hash is left out of the comparison."""

    def digits(a, b):
        return None if a is None or b is None else len(a) if len(a) != len(b) else differing(a, b)

    def keep(x, last):
        found = [n for n in (digits(x[k], last[k]) for k in ((0,) if p_only else (0, 1))) if n is not None]
        return bool(found) and min(found) > least

    return _fold_frames(frames, key, keep)


def near_boundary(frames: DataFrame, boundaries: DataFrame, key: str, within: float = 2.0) -> DataFrame:
    """``frames`` plus near: a boundary of the video lies less than ``within`` away. Joined by time buckets of that width, each
    boundary in its own and the next on either side, so a video's rows meet only where they may be close."""
    b = boundaries.select(key, F.col("t").alias("_b"), F.explode(F.array(*[F.floor(F.col("t") / within) + i for i in (-1, 0, 1)])).alias("_k"))
    f = frames.withColumn("_k", F.floor(F.col("t") / within))
    met = f.join(b, [key, "_k"]).where(F.abs(F.col("t") - F.col("_b")) < within).select(key, "t").distinct().withColumn("near", F.lit(True))
    return frames.join(met, [key, "t"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def final_frames(frames: DataFrame, key: str, most: int) -> DataFrame:
    """Up to ``most`` frames of a video: all if they are that few; else the first near boundaries for up to half, the rest at even steps."""
    w = Window.partitionBy(key)
    n, near = F.count(F.lit(1)).over(w), F.count_if("near").over(w)
    ranked = frames.withColumn("n", n).withColumn("nb", F.least(near, F.lit(most // 2))).withColumn("rn", F.row_number().over(Window.partitionBy(key, "near").orderBy("t"))).withColumn("others", n - near)
    slots = F.lit(most) - F.col("nb")
    step = F.greatest(F.lit(1), F.floor(F.col("others") / slots))
    good = (F.col("n") <= most) | F.when(F.col("near"), F.col("rn") <= F.col("nb")).otherwise(((F.col("rn") - 1) % step == 0) & ((F.col("rn") - 1) / step < slots))
    return ranked.where(good).select(*frames.columns)


def scene_reduction(segments: DataFrame, key: str, shortest: float, share: float) -> DataFrame:
    """Segments of ``shortest`` seconds or more, the first and the last of a video, and of the others a share of 1 - ``share`` by hash."""
    w = Window.partitionBy(key)
    first, last = F.min(F.struct("start", "id")).over(w), F.max(F.struct("start", "id")).over(w)
    me = F.struct("start", "id")
    out = segments.withColumn("_edge", (me == first) | (me == last))
    return out.where((F.col("end") - F.col("start") >= shortest) | F.col("_edge") | (unit_hash(F.col("id").cast("string")) < 1 - share)).drop("_edge")


def motion_reduction(segments: DataFrame, share: float) -> DataFrame:
    """Segments with any text or under three seconds, and of the others a share of 1 - ``share`` by hash."""
    said = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) != "" for c in ("transcription", "caption", "ocr_text")])
    return segments.where(said | (F.col("end") - F.col("start") < 3) | (unit_hash(F.col("id").cast("string")) > share))


def two_pass_gate(start: Column, coarse: float, fine: float) -> Column:
    return (start % coarse < 1) | (start % fine < 1)


def word_jaccard(a: Column, b: Column) -> Column:
    words = lambda t: F.array_distinct(F.split(F.lower(t), r"\s+"))
    return F.size(F.array_intersect(words(a), words(b))) / F.size(F.array_union(words(a), words(b)))


def skip_similar(segments: DataFrame, key: str, text: str, over: float = 0.8) -> DataFrame:
    """Segments whose words are not nearly those of the video's first segment (which stays); blank texts stay."""
    first = segments.groupBy(key).agg(F.min_by(F.struct(F.col(text).alias("t"), "id"), F.struct("start", "id")).alias("_f"))
    bare = (F.coalesce(F.trim(F.col(text)), F.lit("")) == "") | (F.coalesce(F.trim(F.col("_f.t")), F.lit("")) == "")
    return segments.join(first, key).where(bare | (F.col("id") == F.col("_f.id")) | ~(word_jaccard(F.col(text), F.col("_f.t")) > over)).drop("_f")


def rate_times(segments: DataFrame, fps: float = 0.0, target: int = 0, every: float = 1.0) -> DataFrame:
    """One row per sampling time from start, before end: by frames per second, else ``target`` times per segment, else every ``every`` seconds (one at least)."""
    duration = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    step = F.lit(1.0 / fps) if fps > 0 else F.when(duration > 0, duration / target).otherwise(max(1.0, every)) if target > 0 else F.lit(max(1.0, every))
    n = F.ceil(F.round(duration / step, 9)).cast("int")
    rows = segments.withColumn("_s", step).withColumn("_n", n).where(F.col("_n") >= 1)
    return rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("t", F.col("start") + F.col("n") * F.col("_s")).drop("_s", "_n")


def keyframes_by_duration(segments: DataFrame) -> DataFrame:
    """1 keyframe under 5 seconds, up to 2 under 15, else up to 4, evenly placed and moved a little by a hash of the id."""
    d = F.col("end") - F.col("start")
    n = F.when(d < 5, 1).when(d < 15, F.least(F.lit(2), F.ceil(d / 8))).otherwise(F.least(F.lit(4), F.ceil(d / 6))).cast("int")
    rows = segments.select("*", n.alias("_n"), F.explode(F.sequence(F.lit(1), n)).alias("n"))
    step = d / (F.col("_n") + 1)
    wobble = F.when(F.col("_n") == 1, F.least(F.lit(1.0), d * 0.1)).otherwise(F.least(F.lit(0.5), step * 0.1))
    return rows.withColumn("t", F.col("start") + step * F.col("n") + (unit_hash(F.col("id").cast("string"), F.col("n").cast("string")) - 0.5) * wobble).drop("_n")


def reduction(total: Column, coarse: Column, fine: Column) -> Column:
    """Per cent of the segments that are left out."""
    return F.when(total > 0, (total - (coarse + fine)) / total * 100).otherwise(0.0)
