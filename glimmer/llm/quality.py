"""Quality classification by random-indexing word vectors and a two-layer network.

Words are runs of letters, of digits or of other marks, as written. A word is known by one of ``BUCKETS`` hash buckets. Every
bucket has an index vector: ``DIMS`` numbers of which ``SIGNS`` are 1 or -1 and the others 0. A word's context vector is the
sum of the index vectors of the words up to ``WINDOW`` places away, counted over all texts. Its word vector is the context
vector, less the mean of all occurrences and scaled to length one, joined with the index vector itself. A document is the mean
of its words' vectors, its share of distinct words and its length on a log scale. A network of one hidden layer and one output
scores that, and the temperature that fits labelled rows kept out of training best turns the output into a probability.

Rows without words (null, empty or blank texts) are pooled to zeros and get the network's score for that. Labels other than 0
and 1, null ids and ids whose labels differ teach nothing; repeated labels, and rows equal in id and text, teach once. At most
``SLOTS`` rows of each label are learned from, chosen by a hash over all labelled rows and weighted back to their number.
Without any label every score is 0.5, with labels of one kind only it is that label. Repeated rows each get a result. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import give_back, prepare, stage
from glimmer.llm.shingles import forget, word_hashes

BUCKET_BITS = 14
BUCKETS, DIMS, SIGNS, WINDOW = 1 << BUCKET_BITS, 64, 4, 2
#: Bound of the labelled sample, for each label.
SLOTS = 8192
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
#: Every so many labelled rows one is kept for the temperature.
KEPT = 5
#: Bytes of text whose words are hashed together, and words whose vectors are held at once.
SEGMENT, CHUNK = 1 << 20, 1 << 16
#: Pieces in which the context vectors are added up.
PIECES = 64
#: Input splits that one task of the corpus count reads, where there are enough: each task sends up to BUCKETS * (DIMS + 1) numbers.
SPLITS = 8
#: Class of each byte: 0 blank, 1 letter (or part of one), 2 digit, 3 other.
KIND = np.array([0 if 9 <= b <= 13 or b == 32 else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero numbers of every bucket's index vector."""
    rng = np.random.default_rng(11)
    return np.argsort(rng.random((BUCKETS, DIMS), np.float32), axis=1)[:, :SIGNS].astype(np.int64), rng.choice(np.array([-1, 1], np.int64), (BUCKETS, SIGNS))


def words_of(texts: list[str | None]):
    """(first text, number of texts, bucket of each word, the text of each word) by runs of texts of about SEGMENT bytes."""
    start = 0
    while start < len(texts):
        coded, n = [], 0
        while start + len(coded) < len(texts) and (not coded or n < SEGMENT):
            coded.append((texts[start + len(coded)] or "").encode("utf-8", "surrogatepass"))
            n += len(coded[-1]) + 1
        data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
        kind = KIND[data]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        data = np.where(kind > 0, data, np.uint8(32))
        hashes, at = word_hashes(np.insert(data, cut, 32))
        bounds = np.cumsum([0] + [len(c) + 1 for c in coded])[:-1]
        doc = np.searchsorted(bounds + np.searchsorted(cut, bounds), at, side="right") - 1
        yield start, len(coded), (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), doc
        start += len(coded)


def count_contexts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vector and occurrences of every bucket, over all texts: tables of a fixed size, added up piece by piece."""
    spark = docs.sparkSession
    prepare(spark)

    def count(batches):
        places, signs = index_vectors()
        total, n = np.zeros(BUCKETS * DIMS, np.int64), np.zeros(BUCKETS, np.int64)
        for rb in batches:
            for _, _, b, doc in words_of(rb.column(0).to_pylist()):
                n += np.bincount(b, minlength=BUCKETS)
                for off in range(1, WINDOW + 1):
                    same = doc[off:] == doc[:-off]
                    left, right = b[:-off][same], b[off:][same]
                    for own, other in ((left, right), (right, left)):
                        for k in range(SIGNS):
                            np.add.at(total, own * DIMS + places[other, k], signs[other, k])
            give_back()
        forget()
        both = np.concatenate((total.reshape(BUCKETS, DIMS), n[:, None]), axis=1).reshape(PIECES, -1)
        live = [k for k in range(PIECES) if both[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([zlib.compress(both[k].tobytes(), 1) for k in live], pa.binary())], ["piece", "body"])

    def add(key, table):
        total = np.zeros(BUCKETS // PIECES * (DIMS + 1), np.int64)
        for x in table.column("body"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    texts = docs.select("text")
    tasks = max(2 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // SPLITS)
    got = texts.coalesce(tasks).mapInArrow(count, "piece int, body binary").groupBy("piece").applyInArrow(add, "piece int, body binary").collect()  # PIECES rows
    out = np.zeros((PIECES, BUCKETS // PIECES * (DIMS + 1)), np.int64)
    for r in got:
        out[r["piece"]] = np.frombuffer(zlib.decompress(r["body"]), np.int64)
    out = out.reshape(BUCKETS, DIMS + 1)
    return out[:, :DIMS], out[:, DIMS]


def word_vectors(contexts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Context part (less the mean of all occurrences, length one) and index part of every bucket."""
    mean = contexts / np.maximum(n, 1)[:, None]
    mean -= contexts.sum(axis=0) / max(int(n.sum()), 1)
    mean /= np.maximum(np.linalg.norm(mean, axis=1), 1e-9)[:, None]
    mean[n == 0] = 0
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMS))
    np.put_along_axis(own, places, signs / np.sqrt(SIGNS), axis=1)
    return np.concatenate((mean, own), axis=1).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Per text the mean of its words' vectors, the share of distinct words and the log of their number."""
    out = np.zeros((len(texts), vectors.shape[1] + 2))
    for first, size, b, doc in words_of(texts):
        n = np.bincount(doc, minlength=size)
        for s in range(0, len(b), CHUNK):
            d = doc[s : s + CHUNK]
            edge = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            out[first + d[edge], :-2] += np.add.reduceat(vectors[b[s : s + CHUNK]], edge, axis=0, dtype=np.float64)
        distinct = np.bincount(np.unique(doc << BUCKET_BITS | b) >> BUCKET_BITS, minlength=size)
        out[first : first + size, :-2] /= np.maximum(n, 1)[:, None]
        out[first : first + size, -2] = distinct / np.maximum(n, 1)
        out[first : first + size, -1] = np.log1p(n) / 10
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def output(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x) / self.temperature, -40, 40)))


def loss(output: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Mean log loss."""
    return float((np.logaddexp(0, np.where(y > 0, -output, output)) * weight).sum() / weight.sum())


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Adam on the weighted log loss of all but every KEPT-th row, which set the temperature."""
    rng = np.random.default_rng(5)
    order = rng.permutation(len(x))
    kept, used = (order[::KEPT], np.delete(order, slice(None, None, KEPT))) if len(x) >= 10 * KEPT else (order, order)
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            a = z[rows]
            h = np.maximum(a @ params[0] + params[1], 0)
            o = h @ params[2] + params[3]
            g = (1 / (1 + np.exp(-np.clip(o, -40, 40))) - y[rows]) * weight[rows] / weight[rows].sum()
            back = np.outer(g, params[2]) * (h > 0)
            step += 1
            for k, d in enumerate((a.T @ back + DECAY * params[0], back.sum(axis=0), h.T @ g + DECAY * params[2], np.array([g.sum()]))):
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    out = net.output(x[kept])
    tried = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    net.temperature = float(tried[np.argmin([loss(out / t, y[kept], weight[kept]) for t in tried])])
    return net


def in_training(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the doc_id's text, modulo 3, is not 1 (a null doc_id counts as an empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3 != 1


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    constant: float = 0.5

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.constant) if self.network is None else self.network.score(pooled(texts, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", slots: int = SLOTS) -> Model:
    """Word vectors from all of ``docs``, and the network from labelled rows that are not held out."""
    spark = docs.sparkSession
    vectors = word_vectors(*count_contexts(docs))
    name = F.xxhash64("doc_id", "text")
    marked = docs.where(in_training() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(name, F.lit(slots)).alias("slot"), name.alias("name"), "text")
    told = labels.where(in_training()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("most"))
    told = told.where((F.col("y") == F.col("most")) & F.col("y").isin(0, 1)).select("doc_id", F.col("y").cast("int").alias("y"))
    # rows of one id are thinned to the slots before they meet its label; then each label's slots keep one row each
    thin = marked.groupBy("doc_id", "slot").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    won = stage(thin.join(told, "doc_id").groupBy("y", "slot").agg(F.min(F.struct("name", "doc_id")).alias("k"), F.sum("n").alias("n")), "quality-slots")
    counted = {r["y"]: (r["n"], r["rows"]) for r in won.groupBy("y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}  # two rows
    if len(counted) < 2:
        return Model(vectors, None, float(next(iter(counted), 0.5)))
    keys = won.select("y", "slot", F.col("k.name").alias("name"), F.col("k.doc_id").alias("doc_id"))  # at most 2 * slots rows
    sample = marked.join(F.broadcast(keys), ["doc_id", "slot", "name"]).groupBy("y", "slot").agg(F.first("text").alias("text"))
    shipped = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        for rb in batches:
            x = pooled(rb.column(2).to_pylist(), shipped.value)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "slot", "x"])
            give_back()
        forget()

    rows = sorted((r["y"], r["slot"], bytes(r["x"])) for r in sample.mapInArrow(pool, "y int, slot long, x binary").collect())  # at most 2 * slots rows of fixed width
    y = np.array([r[0] for r in rows], np.float64)
    weight = np.array([counted[r[0]][0] / counted[r[0]][1] for r in rows])
    return Model(vectors, train(np.stack([np.frombuffer(r[2]) for r in rows]), y, weight / weight.mean()))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", slots: int = SLOTS) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if the score is 0.5 or more)."""
    model = fit(docs, labels, label, slots)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for rb in batches:
            s = shipped.value.scores(rb.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
            give_back()
        forget()

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~in_training()).alias("held_out"), "text")
    return thin.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
