"""Operators on small frames with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from glimmer.operators import backfill, catalog_ops, fusion, intervals, keyframes, listing, search, text, understanding, vectors


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_piecewise_score(spark):
    df = spark.createDataFrame([(float(d),) for d in (0, 12, 14.37, 14.5, 15, 17, 20, 27, 30)], "d double")
    got = [r[0] for r in df.select(vectors.piecewise(F.col("d"))).collect()]
    assert got == pytest.approx([1.6, 1.0, 0.8815, 0.875, 0.85, 0.65, 0.35, 0, 0])


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine_similarity(F.col("a"), F.col("b"))).first()[0] == 0


def test_text_only_hits_fall_under_the_cut(spark):
    v = spark.createDataFrame([(1, 0.8815)], "id long, vs double")
    f = spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, fs double")
    assert [(r["id"], round(r["score"], 5)) for r in fusion.hybrid(v, f, 0.7, 0.0, 0.5, 10).collect()] == [(1, 0.91705)]


def test_reciprocal_rank(spark):
    rows = spark.createDataFrame([("A", "x", 2.0), ("A", "y", 1.0), ("B", "y", 2.0), ("B", "z", 1.0)], "list_name string, id string, score double")
    got = {r["id"]: r["score"] for r in fusion.reciprocal_rank(rows).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62})


def test_merge_segments(spark):
    df = spark.createDataFrame([("v", 0.0, 10.0, 1.0), ("v", 12.0, 20.0, 1.0), ("v", 40.0, 41.0, 1.0), ("w", 0.0, 10.0, 1.0), ("w", 9.0, 19.0, 1.0)], "k string, start double, end double, score double")
    assert values(intervals.merge_segments(df, "k").select("k", "start", "end")) == [("v", 0.0, 20.0), ("w", 0.0, 10.0), ("w", 9.0, 19.0)]


def test_merge_cuts(spark):
    df = spark.createDataFrame([([2.3, 0.0, 0.5, 1.2, 1.9, 5.0],), ([],)], "c array<double>")
    assert [r[0] for r in df.select(intervals.merge_cuts(F.col("c"), 1.0)).collect()] == [[0.0, 1.2, 2.3, 5.0], []]


def test_transcript(spark):
    df = spark.createDataFrame([("v", "[00:01:02.500 --> 00:01:04.000] hi\nmore\n[00:02:00.000 --> 00:02:01.000]  \n")], "id string, raw string")
    assert values(intervals.parse_transcript(df)) == [("v", 0, 62.5, 64.0, "hi\nmore")]


def test_progress(spark):
    df = spark.createDataFrame([(2, 0, 4), (4, 1, 4), (4, 4, 4), (0, 0, 0)], "a int, b int, t int")
    got = [tuple(r[0]) for r in df.select(intervals.phase_progress(F.col("a"), F.col("b"), F.col("t"))).collect()]
    assert got == [("phase0", 50), ("phase1", 25), ("completed", 100), ("phase0", 0)]


def test_time_markers(spark):
    df = spark.createDataFrame([("first 5 minutes",), ("after 2 min",), ("beginning",), ("at the end",), (None,), ("a 3 minute clip",), ("after 2 hr",)], "q string")
    assert [r[0] for r in df.select(understanding.time_marker(F.col("q"))).collect()] == ["0-300", "120-end", "0-60", "last-60", None, None, "7200-end"]


def test_ngrams_and_stems(spark):
    df = spark.createDataFrame([("abcd",), ("ab",)], "t string")
    assert [r[0] for r in df.select(text.char_ngrams(F.col("t"), 3)).collect()] == [["abc", "bcd"], ["ab"]]
    assert [text.porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "falling", "happy")] == ["caress", "poni", "relat", "hop", "fall", "happi"]


def test_upsert_is_null_safe(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "s", "b")], "id long, seg string, v string")
    new = spark.createDataFrame([(1, None, "c")], "id long, seg string, v string")
    assert sorted((r["id"], r["v"]) for r in catalog_ops.upsert(old, new, ["id", "seg"]).collect()) == [(1, "c"), (2, "b")]
    assert sorted((r["id"], r["v"]) for r in catalog_ops.upsert(old, new, ["id", "seg"], keep_old=True).collect()) == [(1, "a"), (2, "b")]


def test_families(spark):
    df = spark.createDataFrame([("red car with people",), ("what music",), ("red music",), ("",), (None,)], "q string")
    got = [(r[0]["type"], r[0]["subtypes"]) for r in df.select(understanding.classify(F.col("q"))).collect()]
    assert got == [("spatial", ["visual"]), ("audio", ["sound"]), ("mixed", ["visual", "sound"]), ("mixed", []), ("mixed", [])]


def test_clean_output_and_fallbacks(spark):
    df = spark.createDataFrame([("Here are some key terms for it: a\nb",), ('"quoted"',), ("1. one\n2. two",), ("x" * 200,), (None,)], "a string")
    assert [r[0] for r in df.select(understanding.clean_output(F.col("a"), F.lit("q"))).collect()] == ["a b", "quoted", "one two", "q", "q"]
    df = spark.createDataFrame([("Show me the red cars",), ("find ",)], "q string")
    assert [tuple(r[0]) for r in df.select(understanding.fallback_query(F.col("q"))).collect()] == [("the red cars", ["red", "cars"]), ("find ", [])]


def test_superseded_only_by_new_segments(spark):
    new = spark.createDataFrame([("v", 1, 0.0, 10.0), ("v", 2, 100.0, 110.0), ("v", 3, 200.0, 210.0)], "k string, id long, start double, end double")
    old = spark.createDataFrame([("v", 11, 6.0, 14.0), ("v", 12, 102.0, 111.0), ("v", 13, 201.0, 205.0), ("v", 14, 204.0, 216.0), ("v", 15, 203.9, 220.0)], "k string, o_id long, o_start double, o_end double")
    kinds, gone = intervals.compare_incremental(new, old, "k", bucket=7.0)
    assert {r["id"]: (round(r["share"], 3), r["kind"]) for r in kinds.collect()} == {1: (0.5, "new"), 2: (0.889, "overlapping"), 3: (1.0, "overlapping")}
    assert gone.count() == 0
    assert values(intervals.compare_incremental(new.where("id = 3"), old.where("o_id >= 14"), "k", bucket=7.0)[1]) == [(14, 3), (15, 3)]


def test_gaps_at_both_ends(spark):
    videos = spark.createDataFrame([("a", 100.0), ("b", 10.0)], "k string, duration double")
    regions = spark.createDataFrame([("a", 5.0, 20.0), ("a", 21.0, 30.0), ("a", 60.0, 99.5)], "k string, start double, end double")
    assert values(intervals.gaps(regions, "k", videos)) == [("a", 0.0, 5.0), ("a", 30.0, 60.0), ("b", 0.0, 10.0)]


def test_repeated_cuts_stay(spark):
    df = spark.createDataFrame([("v", 10.0, [4.0, 4.0])], "k string, duration double, cuts array<double>")
    assert values(intervals.segments_from_cuts(df, "k")) == [("v", 0.0, 6.0), ("v", 2.0, 6.0), ("v", 2.0, 10.0)]


def test_greedy_keyframes(spark):
    rows = [("v", float(t), 0.9 if t in (1, 2) else 0.0, 0.0, 0.0) for t in range(12)] + [("w", 0.3, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, t double, motion double, histogram double, complexity double")
    assert values(keyframes.greedy_keyframes(df, "k")) == [("v", 0.0), ("v", 1.0), ("v", 2.0), ("v", 10.0), ("w", 0.3)]


def test_hashes_of_frames(spark):
    df = spark.createDataFrame([([0] * 32 + [255] * 32, [9 - i % 9 for i in range(72)])], "p array<int>, d array<int>")
    assert tuple(df.select(keyframes.p_hash(F.col("p")), keyframes.d_hash(F.col("d"))).first()) == ("00000000ffffffff", "ffffffffffffffff")
    df = spark.createDataFrame([("ab12", "ab34"), ("a", "ab")], "a string, b string")
    assert [r[0] for r in df.select(keyframes.hex_distance(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0]


def test_jitter_stays_in_bounds(spark):
    v = spark.createDataFrame([(i, 100.0) for i in range(20)], "id long, duration double")
    cuts = keyframes.fallback_cuts(v, "id", "duration").collect()
    assert len(cuts) == 20 * 6 and all(abs(r["t"] - 15 * r["n"]) <= 1.5 for r in cuts) and len({r["t"] for r in cuts if r["n"] == 1}) > 5


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(7)], "id long, size long")
    first = listing.cursor_page(df, "size", limit=3).collect()
    assert [r["id"] for r in first] == [6, 5, 4] and first[-1]["next_key"] == 4 and all(r["has_more"] for r in first)
    rest = listing.cursor_page(df, "size", (first[-1]["next_value"], 4), limit=4).collect()
    assert [r["id"] for r in rest] == [3, 2, 1, 0] and not rest[0]["has_more"]
    with pytest.raises(ValueError):
        listing.cursor_page(df, "nothing")


def test_boosts(spark):
    df = spark.createDataFrame([("red car left of tree", '["Car","sky"]'), ("", "[]"), (None, "bad"), (None, None)], "s string, e string")
    got = [tuple(r) for r in df.select(search.spatial_boost(F.col("s"), F.array(F.lit("Car"), F.lit("tree"), F.lit("x")), F.lit("mixed")), search.element_boost(F.lit("a CAR"), F.col("e")), search.quality_bonus(F.col("s"), F.lit(None), F.col("e"))).collect()]
    assert [tuple(round(x, 6) for x in r) for r in got] == [(0.3, 0.05, 0.1), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_small_conversions(spark):
    df = spark.createDataFrame([("abc", "/x/a.b.mp4")], "t string, p string")
    assert tuple(df.select(backfill.text_hash(F.col("t")), backfill.text_hash(F.lit("zzzzzzzz")), backfill.cache_name(F.col("p"))).first()) == (96354, (sum(122 * 31**i for i in range(8)) + 2**31) % 2**32 - 2**31, "a.b_L3gvYS5i")
    assert backfill.snake_columns(spark.createDataFrame([(1,)], "videoPathId int")).columns == ["video_path_id"]


def test_smart_terms(spark):
    df = spark.createDataFrame([("The Running, of dogs!",), ("the of",)], "q string")
    assert [r[0] for r in df.select(text.stem_words(text.smart_terms(F.col("q"), text.STOP_WORDS))).collect()] == [["run", "dog"], ["the", "of"]]


def test_postings_and_prefixes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cats sat"), (2, "cat cat"), (3, None), (4, "dog")], "doc_id long, text string")
    search.write_postings(docs, str(tmp_path))
    found = lambda *a, **k: sorted(r["doc_id"] for r in search.ranked(spark, str(tmp_path), *a, **k).collect())
    assert found(["cat"]) == [2] and found(search.phrases(["cat"], True)) == [1, 2] and found(["cat*", "sat"], all_terms=True) == [1] and found([]) == [] and found(["none"]) == []


def test_media_scan_and_storyline(spark, tmp_path):
    import json

    from glimmer.sources import catalog

    (tmp_path / "deep").mkdir()
    for name in ("a.JPG", "b.txt", "deep/c.png", "deep/d.mp4"):
        (tmp_path / name).write_bytes(b"x")
    found = lambda *a: sorted(r["path"].rsplit("/", 1)[-1] for r in catalog.scan_media(spark, str(tmp_path), *a).collect())
    assert found() == ["a.JPG", "c.png"] and found(catalog.IMAGES, False) == ["a.JPG"] and found(catalog.VIDEOS) == ["d.mp4"] and catalog.count_media(spark, str(tmp_path)) == 2
    rows = spark.createDataFrame([("v", 5.0, 6.0, 2, "b"), ("v", 0.0, 1.0, 1, "a")], "video string, start double, end double, id long, text string")
    catalog.write_storyline(rows, str(tmp_path / "out"))
    said = [json.loads(line) for p in (tmp_path / "out").glob("*.json") for line in p.read_text().splitlines()]
    assert [[s["id"] for s in x["segments"]] for x in said] == [[1, 2]]


def test_knn_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [0.0, 0.0]), (7, [None, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["distance"]) for r in vectors.knn(df, [1.0, 0.0], 5).collect()] == [(1, 0.0), (2, 0.0), (6, 1.0)]


def test_custom_merge_score(spark):
    df = spark.createDataFrame([("v", 0.0, 10.0, 1.0), ("v", 12.0, 20.0, 3.0)], "k string, start double, end double, score double")
    assert [r["score"] for r in intervals.merge_segments(df, "k", scoring=F.max).collect()] == [3.0]
