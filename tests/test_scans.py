"""Passes in order over keys that cover several parts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.operators import backfill, intervals, keyframes, scans


@pytest.fixture
def parts(spark):
    """Small inputs in many parts."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot(n, seed=1):
    """Rows (k, t, x): one key has a third of them, one is null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", "c", "d", None, "z"]), rng.randrange(n) / 4, rng.randrange(50)) for _ in range(n)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", *r[1:])):
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_neighbours_and_running_values(spark, parts):
    rows = list(set(hot(400)))
    df = scans.in_parts(spark.createDataFrame(rows, "k string, t double, x long"), "k", ["t", "x"])
    spread = {r["k"]: r["n"] for r in df.groupBy("k").agg(F.countDistinct(scans.PART).alias("n")).collect()}
    assert spread["hot"] > 1
    got = scans.with_before(df, "k", ["t", "x"], F.col("x"), "sum")
    got = scans.with_before(got, "k", ["t", "x"], F.col("x"), "max", F.max)
    got = scans.with_next(scans.with_previous(got, "k", ["t", "x"], ["x"], "p"), "k", ["t", "x"], ["x"], "n")
    got = {(r["k"], r["t"], r["x"]): (r["sum"], r["max"], r["p"] and r["p"]["x"], r["n"] and r["n"]["x"]) for r in got.collect()}
    assert len(got) == len(rows)
    for k, own in by_key(rows).items():
        xs = [x for _, x in own]
        for i, (t, x) in enumerate(own):
            assert got[k, t, x] == (sum(xs[:i]) if i else None, max(xs[:i], default=None), xs[i - 1] if i else None, xs[i + 1] if i + 1 < len(xs) else None)


def test_windows_ahead_across_chunks(spark, parts, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK", 5)
    rows = list(set(hot(300)))
    df = scans.in_parts(spark.createDataFrame(rows, "k string, t double, x long"), "k", ["t", "x"])
    got = scans.with_following(df, "k", ["t", "x"], 3, {"s": lambda w: F.sum("x").over(w.rowsBetween(0, 2)), "l": lambda w: F.lead("x", 3).over(w)})
    got = {(r["k"], r["t"], r["x"]): (r["s"], r["l"]) for r in got.collect()}
    assert len(got) == len(rows)
    for k, own in by_key(rows).items():
        xs = [x for _, x in own]
        for i, (t, x) in enumerate(own):
            assert got[k, t, x] == (sum(xs[i : i + 3]), xs[i + 3] if i + 3 < len(xs) else None)


def test_values_of_a_key(spark, parts):
    rows = hot(200)
    df = scans.in_parts(spark.createDataFrame(rows, "k string, t double, x long"), "k", ["t"])
    v = spark.createDataFrame([("hot", 1), (None, 2)], "k string, v int")
    assert sorted((r["k"] or "", r["v"]) for r in scans.per_key(df, "k", v).collect()) == sorted((k or "", 1 if k else 2) for k, *_ in rows if k in ("hot", None))


OUT = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("n", T.LongType())])


@pytest.mark.parametrize("memory", ["none", "last", "count"])
def test_fold_against_a_loop(spark, parts, memory):
    """A state that is at once forgotten, one that is soon, and a count, which never is and needs a round for each part."""

    def step(state, values):
        t, x = values
        if memory == "none":
            return None, (t, x)
        if memory == "last":
            return ((t, (t, x)) if state is None or t - state > 3 else (state, None))
        return (state or 0) + 1, (t, (state or 0) + 1)

    rows = hot(500)
    got = scans.fold(spark.createDataFrame(rows, "k string, t double, x long"), "k", ["t", "x"], [], step, OUT)
    want = []
    for k, own in by_key(rows).items():
        state = None
        for values in own:
            state, kept = step(state, values)
            want += [(k, *kept)] if kept else []
    key = lambda r: (r[0] or "", r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    empty = scans.fold(spark.createDataFrame([], "k string, t double, x long"), "k", ["t", "x"], [], step, OUT)
    assert empty.count() == 0 and empty.columns == ["k", "t", "n"]


def test_near_cuts_and_segments_of_a_hot_video(spark, parts):
    rows = [(k or "none", t) for k, t, _ in hot(400, 2)]
    df = spark.createDataFrame(rows, "k string, t double")
    kept = {}
    for k, own in by_key(rows).items():
        for (t,) in own:
            if k not in kept or t - kept[k][-1] > 2:
                kept.setdefault(k, []).append(t)
    merged = intervals.merge_near_cuts(df, "k", 2.0)
    assert sorted(map(tuple, merged.collect())) == sorted((k, t) for k, own in kept.items() for t in own)
    videos = [(k, 90.0) for k in kept] + [("bare", 10.0)]
    arrays = spark.createDataFrame([(k, d, kept.get(k, [])) for k, d in videos], "k string, duration double, cuts array<double>")
    got = intervals.cut_segments(merged, spark.createDataFrame(videos, "k string, duration double"), "k", longest=30.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, intervals.segments_from_cuts(arrays, "k", longest=30.0).collect()))


def test_islands_regions_and_gaps_of_a_hot_video(spark, parts):
    rng = random.Random(3)
    rows = [(k or "none", t, t + rng.random() * 4, float(x), x % 3) for k, t, x in hot(400, 4)]
    df = spark.createDataFrame(rows, "k string, start double, end double, intensity double, type int")
    regions = []
    for k, own in by_key(rows).items():
        now = None
        for a, b, x, kind in own:
            if now and a <= now[2] + 1.0:
                now[2] = max(now[2], b)
                if x > now[3]:
                    now[3:] = [x, kind]
            else:
                now = [k, a, b, x, kind]
                regions.append(now)
    got = [(r["k"], r["start"], r["end"], r["intensity"], r["type"]) for r in intervals.merge_regions(df, "k").collect()]
    assert sorted(got) == sorted(map(tuple, regions))
    names = sorted({r[0] for r in regions})
    videos = spark.createDataFrame([(k, 120.0) for k in names[1:]] + [("bare", 9.0)], "k string, duration double")
    want = [("bare", 0.0, 9.0)]
    for k in names[1:]:
        own = sorted(r[1:3] for r in regions if r[0] == k)
        want += [(k, 0.0, own[0][0])] * (own[0][0] > 1) + [(k, b, a) for (_, b), (a, _) in zip(own, own[1:], strict=False)] + [(k, own[-1][1], 120.0)] * (own[-1][1] < 119)
    assert sorted(map(tuple, intervals.gaps(intervals.merge_regions(df, "k"), "k", videos).collect())) == sorted(w for w in want if w[2] - w[1] >= 2)
    scored = df.select("k", "start", "end", F.col("intensity").alias("score"))
    islands = []
    for k, own in by_key([r[:4] for r in rows]).items():
        before = None
        for a, b, _ in own:
            if before:
                shared, span, away = min(b, before[1]) - max(a, before[0]), max(b, before[1]) - min(a, before[0]), a - before[1]
            if before and ((shared > 0 and span > 0 and shared / span > 0.3) or 0 <= away <= 0.5):
                islands[-1][1:] = [min(a, islands[-1][1]), max(b, islands[-1][2]), islands[-1][3] + 1]
            else:
                islands.append([k, a, b, 1])
            before = (a, b)
    got = intervals.merge_segments(scored, "k", gap=0.5, least=0.0).select("k", "start", "end", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, islands))


def test_frames_of_a_hot_video(spark, parts):
    rng = random.Random(5)
    digits = lambda: "".join(rng.choice("ab") for _ in range(4))
    rows = [(k or "none", t, None if rng.random() < 0.05 else digits(), digits(), rng.random() < 0.1) for k, t, _ in hot(300, 6)]
    df = spark.createDataFrame(rows, "k string, t double, p_hash string, d_hash string, near boolean")
    share = lambda x, y: sum(a != b for a, b in zip(x, y, strict=True)) / 4
    loop = []
    for k, own in by_key([(k, t, (p is not None, p or ""), d, n) for k, t, p, d, n in rows]).items():
        last = None
        for t, (has, p), d, near in own:
            if last is None or near or (has and last[0] and (share(p, last[1]) * 0.7 + share(d, last[2]) * 0.3 > 0.5 or share(d, last[2]) > 0.2)):
                loop.append((k, t))
                last = (has, p, d)
    got = sorted(map(tuple, keyframes.distinct_frames(df, "k", least=0.5).collect()))
    assert got == sorted(loop)


def test_keyframes_and_context_of_a_hot_video(spark, parts):
    rng = random.Random(7)
    rows = [(k or "none", t, rng.random() * 0.4, rng.random() * 0.4, rng.random()) for k, t, _ in hot(900, 8)]
    got = keyframes.greedy_keyframes(spark.createDataFrame(rows, "k string, t double, motion double, histogram double, complexity double"), "k", longest=20.0, most=60)
    want = []
    scored = [(k, t, m * 0.3 + h * 0.4 + c * 0.3, c) for k, t, m, h, c in rows]
    for k, own in by_key([(k, t, s, s * 1.5 if c > 0.7 else s) for k, t, s, c in scored]).items():
        last, n = None, 0
        for t, _, b in own:
            force = last is None or t - last >= 20
            keep = force or (t - last >= 0.5 and b >= 0.2)
            near = not force and t - last >= 0.5
            if keep:
                want.append((k, t))
                last, n = t, n + 1
            if near and n >= 60:
                break
    assert sorted(map(tuple, got.collect())) == sorted(want)
    spans = [(k or "none", t, t + rng.random() * 9, i) for i, (k, t, _) in enumerate(hot(300, 9))] + [("none", None, 3.0, 900), ("none", 8.0, None, 901)]
    got = {r["id"]: r["before"] for r in backfill.ended_before(spark.createDataFrame(spans, "k string, start double, end double, id long"), "k", 3).collect()}
    for k, a, _, i in spans:
        done = sorted((s is not None, s or 0, j) for q, s, e, j in spans if q == k and e is not None and a is not None and e < a)
        assert got[i] == [j for *_, j in done[-3:]]
