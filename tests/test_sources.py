"""Tables that are changed in place, trees of media files, substring search by trigrams, prepared queries, values by place."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glimmer.operators import keyframes, listing, pages, search, substrings, text
from glimmer.sources import folders, upserts


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows(spark, path):
    return {r["id"]: r["v"] for r in upserts.read_table(spark, path).collect()}


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(200).select("id", F.lit("a").alias("v"))
    assert upserts.write_changes(df, path, "id", buckets=8) == list(range(8))
    before = files(path)
    touched = upserts.write_changes(df.where("id = 7").withColumn("v", F.lit("b")), path, "id", buckets=8)
    after = files(path)
    assert len(touched) == 1 and {p for p in before if f"bucket={touched[0]}/" not in p} == set(before) & set(after)
    assert all(before[p] == after[p] for p in set(before) & set(after))
    assert rows(spark, path) == {i: "b" if i == 7 else "a" for i in range(200)}
    assert upserts.write_changes(df.where("false"), path, "id", buckets=8) == [] and files(path) == after


def test_changes_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (2, "w"), (3, None)], "id long, v string")
    for _ in range(2):
        upserts.write_changes(new, path, "id", buckets=4)
        assert rows(spark, path) == {1: "x", 2: "w", 3: None}
    for _ in range(2):
        upserts.write_changes(spark.createDataFrame([(1, "no"), (4, "z")], new.schema), path, "id", keep_old=True, buckets=4)
        assert rows(spark, path) == {1: "x", 2: "w", 3: None, 4: "z"}
    for _ in range(2):
        upserts.write_changes(new.where("false"), path, "id", gone=new.where("id > 1"), buckets=4)
        assert rows(spark, path) == {1: "x", 4: "z"}
    upserts.write_changes(new.where("false"), path, "id", gone=spark.createDataFrame([(1,), (4,)], "id long"), buckets=4)
    assert not files(path)


@pytest.fixture
def tree(tmp_path):
    for name in ("a.JPG", "b.mp4", "c.txt", "one/d.png", "one/two/e.mkv", "one/two/f.jpg", "empty/x.doc"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    return tmp_path


def test_a_tree_is_listed_in_tasks(spark, tree):
    name = lambda r: str(Path(r["path"]).relative_to(tree))
    df = folders.read_folder(spark, str(tree))
    assert {(name(r), r["type"], r["length"]) for r in df.collect()} == {("a.JPG", "image", 5), ("b.mp4", "video", 5), ("one/d.png", "image", 9), ("one/two/e.mkv", "video", 13), ("one/two/f.jpg", "image", 13)}
    assert df.rdd.getNumPartitions() == 3  # its own files and two folders
    assert {name(r) for r in folders.read_folder(spark, f"file://{tree}", recursive="false").collect()} == {"a.JPG", "b.mp4"}
    assert {name(r) for r in folders.read_folder(spark, str(tree), types="video").collect()} == {"b.mp4", "one/two/e.mkv"}
    assert {name(r) for r in folders.read_folder(spark, str(tree), extensions="doc,txt").collect()} == {"c.txt", "empty/x.doc"}


def test_what_is_found_is_enqueued_once(spark, tree):
    known = spark.createDataFrame([("j1", str(tree / "a.JPG"), 1, "pending"), ("j2", str(tree / "b.mp4"), 1, "failed")], "id string, path string, pass int, status string")
    got = {Path(r["path"]).name: (r["id"], r["created"]) for r in folders.enqueue(spark, str(tree), known).collect()}
    assert got["a.JPG"] == ("j1", False) and got["b.mp4"][1] and len(got) == 5
    again = {Path(r["path"]).name: r["id"] for r in folders.enqueue(spark, str(tree), known).collect()}
    assert again == {k: v[0] for k, v in got.items()}


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    alphabet = "abAB é%_"
    data = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))) if i % 9 else None, "".join(rng.choice(alphabet) for _ in range(5))) for i in range(400)]
    df, path = spark.createDataFrame(data, "id long, name string, path string"), str(tmp_path / "grams")
    substrings.write_trigrams(df, path, "id", ["name", "path"])
    for needle in ("aba", "AB é", "b%_a", "a", "", "zzz", "abababab"):
        for wanted in (["name"], ["name", "path"]):
            want = {r["id"] for r in df.where(listing.holds(needle, *[F.col(c) for c in wanted])).collect()}
            assert {r["id"] for r in substrings.holding(df, path, needle, "id", ["name", "path"], wanted).collect()} == want
    assert {r["key"] for r in substrings.candidates(spark, path, "aba", ["name", "path"], ["path"]).collect()} == {i for i, _, p in data if "aba" in p.lower()}


def test_trigrams_of_many_rows_are_put_together(spark, tmp_path):
    """A common trigram has a row for each batch, not for each text, and keys of any kind."""
    df, path = spark.createDataFrame([(f"k{i}", "Same text" if i % 3 else None, f"n{i % 7}") for i in range(3000)], "id string, name string, path string").coalesce(2), str(tmp_path / "grams")
    substrings.write_trigrams(df, path, "id", ["name", "path"])
    assert spark.read.parquet(path).where("gram = 'sam'").count() <= 6
    assert {r["key"] for r in substrings.candidates(spark, path, "SAME", ["name", "path"], ["name"]).collect()} == {f"k{i}" for i in range(3000) if i % 3}


def test_trigrams_of_long_texts_and_wide_characters(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "x" * 200_000 + "needle"), (2, "a\U0001f600b\nc\U0001f601"), (3, "ab"), (4, None)], "id long, name string"), str(tmp_path / "grams")
    substrings.write_trigrams(df, path, "id", ["name"])
    for needle, want in (("xneed", {1}), ("a\U0001f600b", {2}), ("\nc\U0001f601", {2}), ("\U0001f600b\n", {2}), ("ab", {3}), ("abc", set())):
        assert {r["id"] for r in substrings.holding(df, path, needle, "id", ["name"]).collect()} == want


def test_queries_are_prepared_from_raw_text(spark):
    assert search.prepared("The  Running dogs, a X!") == ["run", "run*", "dog", "dog*"]
    assert search.prepared("the, and") == ["the", "the*", "and", "and*"] and search.prepared(" ") == []
    assert search.prepared("Running up", stemmed=False, prefixes=False) == ["running"]
    q = spark.createDataFrame([(1, ["running", "dogs", "running"]), (2, []), (3, None), (4, ["unknown"])], "id long, words array<string>")
    stems = text.stem_dictionary(q.where("id < 4").select(F.explode("words").alias("word")))
    assert stems.count() == 2
    assert {r["id"]: r["stems"] for r in text.stems_of(q, "id", F.col("words"), stems).collect()} == {1: ["run", "dog", "run"], 2: [], 3: [], 4: ["unknown"]}


def test_values_by_place(spark):
    rng = random.Random(6)
    data = [(rng.choice(["hot", "hot", "a", "b"]), rng.choice([None, *range(12)])) for _ in range(500)] + [("one", 3), ("none", None)]
    df = spark.createDataFrame([(k, None if s is None else float(s), i) for i, (k, s) in enumerate(data)], "k string, score double, sample long")
    want = {}
    for k in ("hot", "a", "b", "one"):
        own = sorted((s for q, s in data if q == k and s is not None), reverse=True)
        want[k] = tuple(float(own[min(len(own) - 1, int(len(own) * x))]) for x in (0.2, 0.3))
    assert {r["k"]: (r["p80"], r["p70"]) for r in keyframes.cut_offs(df, "k", "score").collect()} == want
    live = df.where("score IS NOT NULL").withColumn("duration", F.lit(9.0))
    got = keyframes.top_share(live, "k", "duration", "background").collect()
    for k in want:
        own = sorted((-s, i) for i, (q, s) in enumerate(data) if q == k and s is not None)
        n = len(own)
        take = next((x for x in (max(1, -(-n // 4)), max(1, -(-2 * n // 5))) if x >= 3), 3 if n >= 3 else n)
        assert sorted((r["rn"], r["sample"]) for r in got if r["k"] == k) == [(j, i) for j, (_, i) in enumerate(own[: min(take, 20)], 1)]


def walk(spark, path, descending, limit):
    after, got, most = None, [], 0
    while True:
        most = max(most, len(pages.files_of_page(spark, path, after, descending, limit)))
        page = pages.clustered_page(spark, path, "v", "id", after, descending, limit).orderBy("rn").collect()
        got += [(r["v"], r["id"]) for r in page]
        if not page or not page[-1]["has_more"]:
            return got, most
        after = (page[-1]["next_value"], page[-1]["next_key"])


@pytest.mark.parametrize("descending", [True, False])
def test_clustered_pages_are_those_of_all_rows(spark, tmp_path, descending):
    """Ties that fill several files, a third without a value; a page opens few of the files."""
    rng = random.Random(5)
    values = [None if i % 3 == 0 else 7 if i % 3 == 1 else rng.randrange(20) for i in range(900)]
    path = str(tmp_path / "pages")
    pages.write_clustered(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v int"), path, "v", "id", file_rows=50)
    sign = -1 if descending else 1
    wanted = sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is None, sign * (x[0] or 0), sign * x[1]))
    got, most = walk(spark, path, descending, 120)
    assert got == wanted
    files = len(list(Path(path, "rows").glob("*.parquet")))
    assert files >= 15 and most <= 6
    page = pages.clustered_page(spark, path, "v", "id", (7, 400), descending, 3)
    assert len(page.inputFiles()) <= 2


def test_clustered_pages_of_nothing_and_of_text(spark, tmp_path):
    path = str(tmp_path / "none")
    rows = spark.createDataFrame([], "id long, v string")
    pages.write_clustered(rows, path, "v", "id")
    assert pages.clustered_page(spark, path, "v", "id").count() == 0
    path = str(tmp_path / "text")
    pages.write_clustered(spark.createDataFrame([(1, "b"), (2, ""), (3, None), (4, "a")], rows.schema), path, "v", "id", file_rows=1)
    assert walk(spark, path, False, 1)[0] == [("", 2), ("a", 4), ("b", 1), (None, 3)]
    assert pages.clustered_page(spark, path, "v", "id", (None, 3), False).count() == 0
