"""Document quality by random-indexing word vectors and a small network.

Words are the pieces of :func:`vellum.llm.text.units`, reduced to a class if they are upper case,
numbers or repetitions of the word before, and hashed to ``WORDS`` rows.  Each word has a sparse ternary index vector; a word's
context vector is the sum of the index vectors of its neighbours (up to ``WINDOW`` away) over all
documents.  Partial sums of fixed size are made by tasks of a few scan partitions each and added up in
slices, as a tree.  Centred, unit-length context vectors are pooled per document (mean, and mean of squares),
and a two-layer network gives a logit, divided by a temperature that is fitted on documents
withheld from the weights.

The network is fitted on at most ``PER_CLASS`` labelled documents of each class (those of the least
hash of doc_id among documents that are not held out), whole texts; context vectors are made of all
documents, and all are scored.

Null and empty texts pool to zeros and get the score of that vector.  Rows with null doc_id or
labels aren't learned from; of several labels of a document the least counts.  With labels
of one class only, or none, every score is the share of that class (0.5 with none).
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import job, text

WORDS, DIM, NONZERO, WINDOW = 1 << 13, 48, 4, 2
PER_CLASS, HIDDEN, EPOCHS, THRESHOLD = 2500, 24, 80, 0.3
#: Rows of the vector table that one slice of the partial sums holds.
SLICE_ROWS = 512
_UPPER, _NUMBER, _AGAIN = 0, 1, 2
_CLASSES = 3


def word_ids(c: text.Coded) -> np.ndarray:
    """Rows of all pieces.  Upper case, numbers and a repetition of the word before are classes of
    their own; others are hashed."""
    own = (text.hash_pieces([p.strip().lower() for p in c.pieces]) % np.uint64(WORDS - _CLASSES)).astype(np.int64)
    ids = _CLASSES + own
    for k, p in enumerate(c.pieces):
        s = p.strip()
        if s.isdigit():
            ids[k] = _NUMBER
        elif len(s) > 1 and s.isalpha() and s.isupper():
            ids[k] = _UPPER
    if not len(c.codes):
        return np.zeros(0, np.int64)
    out, word = ids[c.codes], own[c.codes]
    again = np.flatnonzero(word[1:] == word[:-1]) + 1
    again = again[~np.isin(again, c.ptr)]
    out[again] = _AGAIN
    return out


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries, [WORDS, NONZERO] each."""
    rng = np.random.default_rng(11)
    place = np.argsort(rng.random((WORDS, DIM)), axis=1)[:, :NONZERO]
    return place, rng.choice([-1.0, 1.0], (WORDS, NONZERO))


def add_contexts(total: np.ndarray, ids: np.ndarray, doc: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Adds to ``total`` [WORDS * DIM] the index vectors of the neighbours of each word."""
    for k in range(1, WINDOW + 1):
        if len(ids) <= k:
            break
        same = doc[k:] == doc[:-k]
        a, b = ids[:-k][same], ids[k:][same]
        for word, other in ((a, b), (b, a)):
            for z in range(NONZERO):
                total += np.bincount(word * DIM + place[other, z], sign[other, z], WORDS * DIM)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """[WORDS, DIM] sums over all texts; see job.summed()."""

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        place, sign = index_vectors()
        for part in text.slices(batch):
            c = text.units(part.column("text"))
            ids = word_ids(c)
            if len(ids):
                add_contexts(total.reshape(-1), ids, c.docs, place, sign)

    return job.summed(docs, ["text"], fill, (WORDS, DIM), SLICE_ROWS)


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    v = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    seen = norm[:, 0] > 0
    if seen.any():
        v[seen] -= v[seen].mean(0)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)


def pooled(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """[documents, 2 DIM + 3]: means, means of squares, and the shares of the three classes."""
    c = text.units(col)
    ids = word_ids(c)
    size = np.diff(c.ptr)
    out = np.zeros((len(size), 2 * DIM + _CLASSES), np.float32)
    doc = c.docs
    for at in range(0, len(ids), 100_000):
        d, i = doc[at:at + 100_000], ids[at:at + 100_000]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        v = vectors[i]
        out[d[first], :DIM] += np.add.reduceat(v, first, axis=0)
        out[d[first], DIM:2 * DIM] += np.add.reduceat(v * v, first, axis=0)
        for k in range(_CLASSES):
            out[d[first], 2 * DIM + k] += np.add.reduceat((i == k).astype(np.float32), first)
    return out / np.maximum(size, 1).astype(np.float32)[:, None]


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _nll(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Net:
    """Adam on the log loss, rows weighted as they are; every fifth row calibrates the temperature."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    rest = np.arange(len(y)) % 5 == 4
    if len(set(y[~rest])) < 2 or len(set(y[rest])) < 2:
        rest = np.zeros(len(y), bool)
    mean, scale = x[~rest].mean(0), x[~rest].std(0) + 1e-3
    n_in = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / n_in), (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    xs, ys = (x[~rest] - mean) / scale, y[~rest].astype(np.float64)
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ys))
        for at in range(0, len(order), 64):
            k = order[at:at + 64]
            a = xs[k] @ p[0] + p[1]
            h = np.maximum(a, 0)
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - ys[k]) / len(k)
            back = np.outer(d, p[2]) * (a > 0)
            grads = [xs[k].T @ back + 1e-3 * p[0], back.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            t += 1
            rate = 3e-3 * (1 - 0.9 * epoch / EPOCHS)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Net(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if rest.any():
        z = net.logits(x[rest])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(grid[np.argmin([_nll(z / g, y[rest]) for g in grid])])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    net: Net | None
    base: float

    def score(self, col: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(col), self.base)
        return self.net.probability(pooled(col, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality."""
    vectors = unit_vectors(context_vectors(docs))
    usable = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rank = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= per_class).collect()
    y_of = {r["doc_id"]: int(r["quality"] == 1) for r in chosen}
    if not y_of:
        return Model(vectors, None, 0.5)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    width = 2 * DIM + _CLASSES

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                x = pooled(part.column("text"), shared.value)
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    rows = docs.where(F.col("doc_id").isin(list(y_of))).select("doc_id", "text").mapInArrow(pool, "doc_id bigint, x binary").collect()
    rows = sorted(rows, key=lambda r: (text.crc_of_id(r["doc_id"]), r["doc_id"], bytes(r["x"])))
    y = np.array([y_of[r["doc_id"]] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(vectors, None, float(y.mean()) if len(y) else 0.5)
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, width)
    return Model(vectors, train(x, y), float(y.mean()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                ids = part.column("doc_id").cast(pa.int64())
                s = shared.value.score(part.column("text")).astype(np.float64)
                yield pa.record_batch(
                    [ids, pa.array(text.held_out(ids.to_pylist())), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op5_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    job.arrow_batches(spark)
    docs = job.documents(spark, sf_dir)
    return predict(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
