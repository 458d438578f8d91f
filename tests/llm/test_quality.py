"""The quality classifier: held-out labels, its parts against plain versions, odd cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import quality
from glimmer.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, quality string, y int", "doc_id long, quality int, text string"
TEXTS = [None, "", " \t\n", "The cat, the cat; 42 cats &&& éa", "a " * 3000 + "z9!!", "one", "the dog\x1f \x0b and the cat"]


def test_held_out_labels(spark):
    rows = QUERIES["op13_quality"](spark, SF).collect()
    told = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["score"], told[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in told]
    assert sum(y == p for _, y, p in held) >= 0.97 * len(held)
    good, bad = (np.array([s for s, y, _ in held if y == k]) for k in (1, 0))
    assert len(bad) and (good[:, None] > bad).mean() > 0.97


def plain_words(text):
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", (text or "").encode())


def test_words():
    """The words of each text, by equal and different buckets, and the text that each is of."""
    known = {}
    for first, n, b, doc in quality.words_of(TEXTS):
        assert (first, n) == (0, len(TEXTS))
        want = [(i, w) for i, t in enumerate(TEXTS) for w in plain_words(t)]
        assert [i for i, _ in want] == doc.tolist()
        for (_, w), k in zip(want, b.tolist(), strict=True):
            assert known.setdefault(w, k) == k
    assert len(set(known.values())) >= len(known) - 1


def test_contexts_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(quality, "SEGMENT", 64)
    got, n = quality.count_contexts(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    places, signs = quality.index_vectors()
    index = np.zeros((quality.BUCKETS, quality.DIMS), np.int64)
    np.put_along_axis(index, places, signs, axis=1)
    want, seen = np.zeros_like(index), Counter()
    for t in TEXTS:
        b = [k for _, _, b, _ in quality.words_of([t]) for k in b.tolist()]
        seen.update(b)
        for i, k in enumerate(b):
            for j in range(max(0, i - quality.WINDOW), min(len(b), i + quality.WINDOW + 1)):
                want[k] += index[b[j]] * (i != j)
    assert (got == want).all() and {k: v for k, v in enumerate(n.tolist()) if v} == seen


def test_pooling_against_plain_means(monkeypatch):
    vectors = np.random.default_rng(3).normal(size=(quality.BUCKETS, 6)).astype(np.float32)
    for chunk in (7, 1 << 16):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        got = quality.pooled(TEXTS, vectors)
        for t, row in zip(TEXTS, got, strict=True):
            b = [k for _, _, b, _ in quality.words_of([t]) for k in b.tolist()]
            want = [*(vectors[b].mean(axis=0, dtype=np.float64) if b else np.zeros(6)), len(set(b)) / max(1, len(b)), np.log1p(len(b)) / 10]
            assert np.allclose(row, want)


def test_network_learns_and_its_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))  # no single layer separates these
    y = (rng.random(3000) < p).astype(float)
    net = quality.train(x[:2000], y[:2000], np.ones(2000))
    s = net.score(x[2000:])
    assert ((s >= 0.5) == (p[2000:] >= 0.5)).mean() > 0.85
    kept = np.random.default_rng(5).permutation(2000)[:: quality.KEPT]  # the rows that no step was trained on
    fits = lambda t: quality.loss(net.output(x[kept]) / t, y[kept], np.ones(len(kept)))
    assert all(fits(net.temperature) <= fits(t) + 1e-4 for t in (0.3, 0.5, 0.8, 1.0, 1.2, 2.0, 5.0))
    assert abs(s.mean() - y[2000:].mean()) < 0.05


def test_odd_rows(spark):
    docs = [(i % 40 if i % 7 else None, "clean words in a line" if i % 2 else "&&& *** $$$", None, i) for i in range(200)]
    docs += [(500, None, None, 0), (501, "", None, 0), (501, "", None, 0), (502, "word " * 40000, None, 0)]
    df = spark.createDataFrame(docs, DOCS)
    labels = [(i, i % 2, "x") for i in range(40)] + [(3, 1, "x"), (5, 0, "x"), (None, 1, "x"), (500, None, "x"), (501, 7, "x")]
    rows = quality.score_quality(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (500, 501)}) == 1
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    assert quality.score_quality(df.where("false"), spark.createDataFrame(labels, LABELS)).count() == 0


@pytest.mark.parametrize(("kinds", "score"), [([], 0.5), ([1], 1.0), ([0], 0.0)])
def test_labels_of_one_kind_or_none(spark, kinds, score):
    df = spark.createDataFrame([(i, f"text {i}", None, 0) for i in range(20)], DOCS)
    labels = spark.createDataFrame([(i, k, "x") for k in kinds for i in range(20)], LABELS)
    assert {r["score"] for r in quality.score_quality(df, labels).collect()} == {score}


def test_the_sample_is_bounded_and_weighted_back(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 360, "plain words of a text").otherwise("plain &&& of ***").alias("text"))
    labels = df.select("doc_id", F.when(F.col("doc_id") < 360, 1).otherwise(0).alias("quality"))
    rows = quality.score_quality(df, labels, slots=16).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] < 360) for r in rows)
