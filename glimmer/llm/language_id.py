"""Language identification by error-correcting output codes.

Each learned language has a binary codeword. For every bit, a naive-Bayes classifier over hashed byte
2- and 3-grams of the lower-cased text tells the languages with 1 from those with 0; each language counts alike,
however many rows it has. Loss-weighted decoding adds up, for each language, the exponential loss of
every bit's margin against its codeword, weighted by how well that bit was learned for that language; the
nearest codeword wins (ties: the smaller language name). The score is the runner-up's share of the two lowest
losses (0.5: undecided, 1: certain); below ``AMBIGUOUS`` the prediction is flagged.

Null text, or text without a letter: ``und`` with score 0. No labelled row at all: every text is ``und``. One
learned language: it is predicted for every text with letters, with score 1. Rows with null lang teach
nothing. The model is fitted on at most ``sample_per_lang`` rows of each of the ``LANGS`` languages with the most rows,
chosen over all rows by a hash of doc_id and text, so rows may share or lack their ids; equal rows are drawn once.
Predictions read whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import give_back, prepare, stage

#: Bound of the labelled sample, for each language.
SAMPLE_PER_LANG = 400
#: Languages that are learned, those with the most labelled rows (ties: by name); it bounds the model where the column is dirty.
LANGS = 1024
BUCKETS = 1 << 15
AMBIGUOUS = 0.55
#: Bytes of text whose grams a worker holds at once.
SEGMENT = 1 << 16
#: Steepness of the loss over the mean log odds of a gram.
SLOPE = 6.0
LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-gram and of the 2-gram that start at each byte but the last two."""
    a, b, c = (data[i : len(data) - 2 + i].astype(np.uint32) for i in range(3))
    two = a * np.uint32(257) + b
    return ((two * np.uint32(263) + c) * np.uint32(2654435761)) >> np.uint32(17), (two * np.uint32(2246822519) + np.uint32(374761393)) >> np.uint32(17)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 / 1: every split of the languages for up to five, else seeded random columns with the best least distance."""
    if n <= 5:
        cols = [[1 if i in side else -1 for i in range(n)] for k in range(1, n) for side in combinations(range(n), k) if 0 in side]
        return np.array(cols, np.int8).reshape(-1, n).T
    bits, rng, best, far = max(15, int(np.ceil(10 * np.log2(n)))), np.random.default_rng(7), None, -1
    for _ in range(64):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        m[:, np.abs(m.sum(axis=0)) == n] = np.where(np.arange(n) % 2, 1, -1)[:, None]
        d = min(int((m[i] != m[j]).sum()) for i, j in combinations(range(n), 2))
        if d > far:
            best, far = m, d
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # buckets x bits, mean log odds of a gram; 3-grams, then 2-grams
    trust: np.ndarray  # languages x bits, rows add up to 1

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds per text and bit."""
        out = np.zeros((len(texts), self.code.shape[1]))
        pending, size = [], 0

        def flush():
            nonlocal pending, size
            joined = np.concatenate([p[1] for p in pending])
            three, two = grams(joined)
            starts = np.cumsum([0] + [len(p[1]) for p in pending])
            rows = self.odds[three]
            rows += self.odds[BUCKETS + two]
            for k, (i, part) in enumerate(pending):
                out[i] += rows[starts[k] : starts[k] + len(part) - 2].sum(axis=0, dtype=np.float64)
            pending, size = [], 0

        n = np.ones(len(texts))
        for i, text in enumerate(texts):
            data = as_bytes(text)
            n[i] = max(1, len(data) - 2)
            for s in range(0, max(1, len(data) - 2), SEGMENT):  # segments share two bytes, so that each gram counts once
                part = data[s : s + SEGMENT + 2]
                if len(part) > 2:
                    pending.append((i, part))
                    size += len(part)
                if size >= SEGMENT:
                    flush()
        if pending:
            flush()
        return out / n[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the codeword is ambiguous."""
        pred, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        live = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        if not live:
            return pred, score, doubt
        if len(self.langs) == 1:
            for i in live:
                pred[i], score[i] = self.langs[0], 1.0
            return pred, score, doubt
        z = np.clip(SLOPE * self.margins([texts[i] for i in live]), -30, 30)
        loss = np.exp(-z[:, None, :] * self.code[None]) * self.trust[None]
        loss = loss.sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(live))
        first, second = loss[rows, order[:, 0]], loss[rows, order[:, 1]]
        s = second / (first + second)
        for k, i in enumerate(live):
            pred[i], score[i], doubt[i] = self.langs[order[k, 0]], s[k], s[k] < AMBIGUOUS
        return pred, score, doubt


def in_training(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the doc_id's text, modulo 4, is not 2 (a null doc_id counts as an empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, train: Column | None = None) -> Model:
    """A model from labelled rows (text, lang) where ``train`` holds."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if train is None else train))
    # each language has slots, and each slot keeps the row of the smallest hash: a bounded sum made before the shuffle
    name = F.xxhash64("doc_id", "text")
    drawn = rows.select(F.col("lang").cast("string").alias("lang"), F.pmod(name, F.lit(sample_per_lang)).alias("slot"), name.alias("name"), "text")
    won = stage(drawn.groupBy("lang", "slot").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")), "language-slots")
    known = stage(won.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).select("lang"), "language-names")
    won = stage(won.join(F.broadcast(known), "lang").select("lang", "slot", "name"), "language-drawn")  # at most LANGS * sample_per_lang rows
    sample = drawn.join(F.broadcast(won), ["lang", "slot", "name"]).groupBy("lang", "slot").agg(F.first("text").alias("text"))

    def tally(key, pdf):
        """Gram counts of one language."""
        counts = np.zeros(2 * BUCKETS)
        for text in pdf["text"]:
            data = as_bytes(text)
            for s in range(0, max(1, len(data) - 2), SEGMENT):
                part = data[s : s + SEGMENT + 2]
                if len(part) > 2:
                    three, two = grams(part)
                    counts[:BUCKETS] += np.bincount(three, minlength=BUCKETS)
                    counts[BUCKETS:] += np.bincount(two, minlength=BUCKETS)
        return pd.DataFrame({"lang": [key[0]], "counts": [counts.astype("<f4").tobytes()]})

    got = {r["lang"]: np.frombuffer(r["counts"], "<f4").astype(np.float64) for r in sample.groupBy("lang").applyInPandas(tally, "lang string, counts binary").collect()}
    if not got:
        return Model([], codewords(1), np.zeros((2 * BUCKETS, 0), np.float32), np.zeros((0, 0)))
    langs = sorted(got)
    code = codewords(len(langs))
    p = np.stack([got[k] for k in langs])
    for half in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        p[:, half] = (p[:, half] + 0.5) / (p[:, half].sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    odds = np.zeros((2 * BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        odds[:, b] = (np.log(p[code[:, b] > 0].mean(axis=0)) - np.log(p[code[:, b] < 0].mean(axis=0))) / 2
    # a bit is trusted for a language by the mean margin that the language's own grams give it
    weight = np.stack([np.stack([(p[k, h] @ odds[h]) for h in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS))]).sum(axis=0) * code[k] for k in range(len(langs))]) if code.shape[1] else np.zeros((len(langs), 0))
    trust = np.maximum(weight, 1e-3)
    return Model(langs, code, odds, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))


def predict_language(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, ambiguous, lettered) of a text column; ``lettered``: the text has a letter, whatever the model."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean, lettered boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        pred, score, doubt = [], [], []
        values = [None if t is None else t for t in texts.tolist()]
        for i in range(0, len(values), 512):
            a, b, c = model.predict(values[i : i + 512])
            pred += a
            score += b.tolist()
            doubt += c.tolist()
        give_back()
        return pd.DataFrame({"lang_pred": pred, "score": score, "ambiguous": doubt, "lettered": [bool(t and LETTER.search(t)) for t in values]})

    return predict.asNondeterministic()(text)  # else a filter and a projection would each run the model


def identify_languages(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous; the model learns from rows that are not held out."""
    model = fit(docs, sample_per_lang, in_training())
    return docs.select("doc_id", (~in_training()).alias("held_out"), predict_language(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")
