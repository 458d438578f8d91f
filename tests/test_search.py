"""Ranked retrieval by blocks, pages with and without values, videos by their best segment, the merge of stores."""

import random

import pytest
from pyspark.sql import functions as F

from glimmer.operators import listing, search, stores


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Documents of many lengths, with a common and a rare word."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        words = ["pad"] * rng.choice([3, 10, 40, 160, 640])
        words += ["common"] * rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])
        rows.append((i, " ".join(words + ["rare"] * (i % 700 == 3))))
    docs = spark.createDataFrame([*rows, (3000, None), (3001, "")], "doc_id long, text string")
    path = str(tmp_path_factory.mktemp("postings"))
    search.write_postings(docs, path)
    return path


@pytest.mark.parametrize("words", [["common"], ["rare"], ["common", "rare"], ["pad", "common"], ["nosuch"], ["common", "nosuch"], ["comm*"], []])
@pytest.mark.parametrize("every", [False, True])
def test_blocks_give_the_same_top(spark, index, words, every):
    whole = search.ranked(spark, index, words, every).select("doc_id", F.round("bm25", 6).alias("bm25"))
    for n in (1, 10, 200):
        got = [(r["doc_id"], round(r["bm25"], 5)) for r in search.ranked_top(spark, index, words, n, every).collect()]
        assert got == [(r["doc_id"], round(r["bm25"], 5)) for r in search.top(whole, n).collect()]


def test_blocks_are_skipped(spark, index, monkeypatch):
    """Fewer postings are read than the terms have."""
    asked = []
    plain = search._posts

    def watched(spark, path, words):
        asked.append(plain(spark, path, words))
        return asked[-1]

    monkeypatch.setattr(search, "_posts", watched)
    page = search.ranked_top(spark, index, ["common"], 10)
    page.collect()
    _, most, _ = search.plan_blocks(spark, index, ["common"])
    every, bar = plain(spark, index, ["common"]), -page.collect()[-1]["bm25"]
    could = [k for k, (best, _) in most.items() if best >= bar - 1e-6]
    assert every.where(F.col("block").isin(could)).count() < every.count() / 2
    assert 1 <= len(asked) <= 3


@pytest.mark.parametrize("words", [["common"], ["common", "comm*", "rare", "ra*"], ["nosuch"], []])
def test_matching_documents_are_those_that_are_ranked(spark, index, monkeypatch, words):
    """For a page without scores the postings are read once."""
    asked = []
    plain = search._posts
    monkeypatch.setattr(search, "_posts", lambda *a: asked.append(plain(*a)) or asked[-1])
    found = search.matching(spark, index, words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("/postings") <= 1 and len(asked) <= 1
    assert sorted(r[0] for r in found.collect()) == sorted(r["doc_id"] for r in search.ranked(spark, index, words).collect())


def test_a_common_term_has_several_writers(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        search.write_postings(spark.range(400).selectExpr("id AS doc_id", "'same length' AS text"), str(tmp_path / "p"))
    finally:
        spark.conf.set(key, before)
    files = spark.read.parquet(str(tmp_path / "p" / "postings")).where(F.col("term") == "same").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1


def test_words_are_counted_before_they_are_shuffled(spark, tmp_path, monkeypatch):
    """A common term is dealt out as few rows of many documents, whatever is counted at a time; what they hold is every count."""
    texts = ["", None, "x", *["a b a " + "c " * (i % 40) + f"only{i}" for i in range(900)], "long " * 5000]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(2)
    want = sorted((f"d{i}", w, (t or "").split().count(w), len((t or "").split())) for i, t in enumerate(texts) for w in set((t or "").split()))
    for words, least in ((2_000_000, 16), (300, 16), (1, 1)):
        monkeypatch.setattr(search, "WORDS", words)
        monkeypatch.setattr(search, "LEAST", least)
        path = str(tmp_path / f"p{words}")
        search.write_postings(docs, path)
        posts = search._posts(spark, path, ["a", "b", "c", "x", "long", "only*"])
        assert sorted((r["doc_id"], r["term"], r["tf"], r["dl"]) for r in posts.collect()) == want
        assert {(r["dl"], r["block"]) for r in posts.collect()} == {(r["dl"], r["b"]) for r in posts.select("dl", search.block(F.col("dl")).alias("b")).collect()}
        size = spark.read.parquet(f"{path}/size").first()
        assert (size["n"], size["id"]) == (len(texts), "d99") and abs(size["avgdl"] * len(texts) - sum(len((t or "").split()) for t in texts)) < 1e-6
        rows = spark.read.parquet(f"{path}/postings").where("term = 'a'").count()
        assert rows < 200 if words == 2_000_000 else rows > 20


def test_postings_follow_their_files(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(1, "old words")], "doc_id long, text string").write.parquet(at)
    first = search.postings(spark, "k", spark.read.parquet(at))
    assert search.postings(spark, "k", spark.read.parquet(at)) == first
    spark.createDataFrame([(2, "new words")], "doc_id long, text string").write.mode("overwrite").parquet(at)
    second = search.postings(spark, "k", spark.read.parquet(at))
    assert [r["doc_id"] for r in search.ranked(spark, second, ["words"]).collect()] == [2]


@pytest.mark.parametrize("descending", [True, False])
def test_pages_cover_all_rows_once(spark, descending):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, size long")
    got, after = [], None
    while True:
        page = listing.cursor_page(df, "size", after, descending, 7).orderBy("rn").collect()
        got += [(r["id"], r["size"]) for r in page]
        if not page or not page[-1]["has_more"]:
            break
        after = (page[-1]["next_value"], page[-1]["next_key"])
    sign = -1 if descending else 1
    assert got == sorted(rows, key=lambda r: (r[1] is None, sign * (r[1] or 0), sign * r[0]))


def test_a_video_is_shown_by_its_best_segment(spark):
    items = spark.createDataFrame([(1, "low", "/v#t=0,5", 0.1), (2, "high", "/v#t=5,9", 0.9), (3, "none", "/v#t=9,12", None), (4, "p", "/w", 0.2), (5, "q", "/w", 0.8)], "id long, name string, path string, score double")
    catalog = spark.createDataFrame([], "id long, name string, path string, type string")
    got = {r["base"]: (r["id"], r["name"], r["matching_segments"]) for r in search.collapse_videos(items, catalog).collect()}
    assert got == {"/v": (2, "high", 3), "/w": (5, "q", 0)}


class Fixed:
    def __init__(self, df):
        self.df = df

    def search(self, query, limit):
        return self.df.orderBy(F.col("score").desc_nulls_last()).limit(limit)


def test_the_merge_of_stores(spark):
    kind = "id long, score double, created_at long"
    a = spark.createDataFrame([(1, 0.9, 5), (2, 0.5, 6), (3, None, 9)], kind)
    b = spark.createDataFrame([(4, 0.7, None), (5, 0.5, 7)], kind).withColumns({"total": F.lit(70), "depth": F.lit(2)})
    page = stores.search_all([Fixed(a), Fixed(b)], "q", 3).collect()
    assert [r["id"] for r in page] == [1, 4, 5] and {(r["total"], r["depth"], r["next_at"], r["next_id"], r["has_more"]) for r in page} == {(73, 2, 7, 5, True)}
    page = stores.search_all([Fixed(a), Fixed(b)], "q", 9).collect()
    assert [r["id"] for r in page] == [1, 4, 5, 2, 3] and {(r["next_id"], r["has_more"]) for r in page} == {(None, False)}
    assert {r["next_id"] for r in stores.search_all([Fixed(b)], "q", 1).collect()} == {None}  # the last result has no time
    assert stores.search_all([Fixed(a.where("false"))], "q", 3).count() == 0
