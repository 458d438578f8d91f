"""Phrase collocations against counts from the definition."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glimmer.llm import collocations, common

KIND = "doc_id long, text string, lang string, phrase string, a int, rank string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))]


def plain(docs, least, longest, top, inside):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        for ws in pieces_of(text):
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und"][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    """Few words, so that phrases overlap, repeat and nest; blanks, tabs, marks and odd characters."""
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "x", "aa", "é", "\x01", "zz\x1f", "longer-word"]
    gaps = [" ", "  ", "\t", ". ", "\n", ";", " \x0b"]
    out = []
    for _ in range(n):
        k = int(rng.integers(0, 30))
        out.append("".join(words[min(8, int(rng.geometric(0.35)) - 1)] + gaps[min(6, int(rng.geometric(0.7)) - 1)] for _ in range(k)))
    return out


CASES = {"plain": {}, "short runs": {"FLUSH": 64, "WRITTEN": 7, "MINED": 9, "SUMMED": 11}, "hot pivots": {"PLACES": 5}, "long groups": {"MINED": 3, "SUMMED": 5, "GROUPS": 2}, "crowded sketch": {"LEAST_BITS": 13, "MOST_BITS": 13}}


@pytest.mark.parametrize("case", list(CASES))
def test_against_the_definition(spark, monkeypatch, case):
    for k, v in CASES[case].items():
        monkeypatch.setattr(collocations, k, v)
    docs = [(t, ["en", "fr", None, "und"][i % 4]) for i, t in enumerate(texts(1, 300))] + [(None, "en"), ("", "de"), ("no phrase", "de"), ("the of the of " * 300, "fr")]
    df = spark.createDataFrame([(i, t, lang, "p", 1, "r") for i, (t, lang) in enumerate(docs)], KIND).repartition(5)
    for least, longest, top, inside in ((5, 5, 1000, 100), (3, 3, 7, 100), (4, 6, 50, 80)):
        got = sorted(map(tuple, collocations.collocations(df, least, longest, top, inside).collect()))
        assert got == plain(docs, least, longest, top, inside) and got


def test_repeated_rows_count_each_and_nothing_frequent_gives_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "p", 1, "r")] * 9, KIND)
    assert [tuple(r) for r in collocations.collocations(df, 9, 5).collect()] == [("en", 1, "a b c", 9, 9, 9, 27, 3000)]
    assert collocations.collocations(df, 10, 5).count() == 0
    assert collocations.collocations(df.where("false"), 2, 5).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as a large corpus has them: the score is the exact quotient."""
    a, left, right, n = 3_000_000_007, 3_000_000_011, 9_000_000_019, 8_000_000_000_009
    rows = [("en", "", 0, n), ("en", "p", 1, left), ("en", "q", 1, right), ("en", "p q", 2, a)]
    monkeypatch.setattr(collocations, "phrases", lambda *_: common.stage(spark.createDataFrame(rows, "lang string, phrase string, words int, a long"), "test"))
    assert collocations.collocations(spark.range(1)).first()["score"] == 1000 * a * n // (left * right) and 1000 * a * n > 1 << 63


def test_a_phrase_has_one_pivot():
    """Every phrase is one beginning of exactly one fragment, of its rarest word."""
    t = collocations.read_text(pa.array(["en", "fr"]), pa.array(["b a b b c a. a a b", "a b a b"]))
    every = np.full(1 << 17, 255, np.uint8)
    s = collocations.Sketch(np.full(1 << collocations.WORD_BITS, 5, np.uint32), {k: every for k in range(2, 6)}, every, 20)
    pivot, first, last = collocations.fragments_of(t, s, 5)
    words = [t.words.distinct[k].as_py() for k in t.words.index.tolist()]
    seen = Counter()
    for p, i, j in zip(pivot.tolist(), first.tolist(), last.tolist(), strict=True):
        assert words[p] == max(words[i : j + 1]) and words[p] not in words[i:p] and j - i <= 4
        seen.update((i, b) for b in range(max(p, i + 1), j + 1))
    ends = np.flatnonzero(np.diff(np.append(t.words.piece, -1)))
    assert seen == Counter((a, b) for a in range(len(words)) for b in range(a + 1, min(a + 4, ends[np.searchsorted(ends, a)]) + 1))


def test_hot_keys_are_dealt_out(spark):
    many = common.stage(spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")), "test")
    one = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = common.join_spread(many, one, ["k"], hot=100)
    assert joined.columns == ["k", "v", "w"]
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, many.join(one, "k").collect()))
