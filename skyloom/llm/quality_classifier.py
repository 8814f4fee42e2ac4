"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word and its shape (runs of small letters, capitals, digits, each sign) have a
sparse random index vector each.  A word's context vector sums the index vectors
of its neighbours in the training texts; word vectors are index plus context
vector.  A document is the mean of its words' and shapes' vectors with its size,
its share of repeated neighbours and of distinct words.  A network of one hidden
layer gives a logit, which a temperature, fitted on held-back rows, makes a
probability.

Training reads at most ``SAMPLE`` labelled documents (those of smallest hash of
the id) on the driver.  Defined cases: null is the empty text, whose vector is
zero; without a labelled row of either class the score is the share of label 1
(1.0 without any label); rows of equal id are judged alike; a null id is never learned
from; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, keeps_cache, small_batches, trim_memory, utf8
from .token_ids import groups_by_size

WORDS, SHAPES, WIDTH, ONES, SAMPLE, HIDDEN, REMEMBERED = 1 << 14, 1 << 10, 32, 6, 6000, 24, 400_000
#: Bytes to shapes: a for small letters and all beyond ASCII, A for capitals, 9 for digits.
SHAPE = bytes((97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b) for b in range(256))
RUN = re.compile(rb"(.)\1+", re.S)
_seen: dict[bytes, int] = {}
keeps_cache("classifier", _seen.clear)


def units(text: str | None) -> np.ndarray:
    """Word and shape number of each word, packed in one integer."""
    words = utf8(text).split()
    if len(_seen) > REMEMBERED:
        _seen.clear()
    for w in [w for w in set(words) if w not in _seen]:
        _seen[w] = (xxhash.xxh64_intdigest(w.lower()) % WORDS) * SHAPES + xxhash.xxh64_intdigest(RUN.sub(rb"\1", w.translate(SHAPE))) % SHAPES
    return np.fromiter(map(_seen.__getitem__, words), np.int64, len(words))


def index_vectors(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((count, WIDTH), np.float32)
    rows = np.arange(count)
    for _ in range(ONES):
        out[rows, rng.integers(0, WIDTH, count)] = rng.choice([-1.0, 1.0], count)
    return out / np.sqrt(ONES)


def word_vectors(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape vectors, with contexts of one neighbour to either side."""
    w, s = index_vectors(WORDS, 1), index_vectors(SHAPES, 2)
    context, seen = np.zeros_like(w), np.zeros(WORDS)
    for u in texts:
        a, b = u // SHAPES, u % SHAPES
        np.add.at(context, a[1:], w[a[:-1]] + s[b[:-1]])
        np.add.at(context, a[:-1], w[a[1:]] + s[b[1:]])
        np.add.at(seen, a, 1)
    return w + context / np.maximum(2 * seen, 1)[:, None].astype(np.float32), s


def features(u: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(2 * WIDTH + 3, np.float32)
    if len(u):
        a, b = u // SHAPES, u % SHAPES
        out[:WIDTH] = vectors[0][a].mean(axis=0)
        out[WIDTH : 2 * WIDTH] = vectors[1][b].mean(axis=0)
        out[-3] = np.log1p(len(u)) / 8
        out[-2] = (a[1:] == a[:-1]).mean() if len(u) > 1 else 0
        out[-1] = len(np.unique(a)) / len(u)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(p: list[np.ndarray], z: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
    """Of the mean cross-entropy, and half of ``decay`` times the squared weights, by both layers' weights and offsets."""
    h = np.tanh(z @ p[0] + p[1])
    d = (sigmoid(h @ p[2] + p[3]) - y) / len(y)
    dh = np.outer(d, p[2]) * (1 - h * h)
    return [z.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]


def train(x: np.ndarray, y: np.ndarray, steps: int = 900, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> dict[str, np.ndarray]:
    """The network by Adam over all rows at once; the last fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    cut = len(z) - len(z) // 5
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    zt, yt = z[:cut], y[:cut]
    for t in range(1, steps + 1):
        for k, g in enumerate(gradients(p, zt, yt, decay)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(z[cut:] @ p[0] + p[1]) @ p[2] + p[3]
    loss = lambda t: -np.mean(np.log(np.where(y[cut:] > 0, sigmoid(logit / t), 1 - sigmoid(logit / t)) + 1e-12)) if len(logit) else 0.0
    return {"mean": mean, "scale": scale, "w1": p[0], "b1": p[1], "w2": p[2], "b2": p[3], "t": np.array(min(np.geomspace(0.25, 8, 41), key=loss))}


def learn(docs: DataFrame, labels: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """The model.  ``trained``: which keys may be learned from."""
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & trained)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # ids alone
    small_batches(docs.sparkSession)

    def run(batches):
        for batch, texts in groups_by_size(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([units(t).astype("<i4").tobytes() for t in texts], pa.binary()), batch.column(2)], names=["k", "u", "y"])

    drawn = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(marks), "doc_id").select("doc_id", "t", "y")
    rows = sorted(drawn.mapInArrow(run, "k long, u binary, y int").toLocalIterator(), key=lambda r: (xxhash.xxh64_intdigest(str(r["k"])), r["u"]))  # at most ``sample``
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return {"prior": float(y.mean()) if len(y) else 1.0}
    texts = [np.frombuffer(r["u"], "<i4").astype(np.int64) for r in rows]
    vectors = word_vectors(texts)
    net = train(np.stack([features(u, vectors) for u in texts]).astype(np.float64), y)
    return {"words": vectors[0], "shapes": vectors[1]} | net


def scores(texts: list[str | None], model: dict) -> np.ndarray:
    if "prior" in model:
        return np.full(len(texts), model["prior"])
    x = np.stack([features(units(t), (model["words"], model["shapes"])) for t in texts]) if texts else np.zeros((0, 2 * WIDTH + 3))
    z = (x - model["mean"]) / model["scale"]
    return sigmoid((np.tanh(z @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]) / model["t"])


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """(key, score); with ``keep`` ("all") the frame itself with a column ``quality_score`` at its end."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    if keep:
        at = docs.columns.index(text)

        def mark(batches):
            drop_caches(but="classifier")
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(at).to_pylist(), sent.value), pa.float64())], names=[*[f"c{i}" for i in range(batch.num_columns)], "s"])
            trim_memory()

        from pyspark.sql.types import DoubleType, StructField, StructType

        kind = StructType([*[StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)], StructField("s", DoubleType())])
        out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(mark, kind)
        return out.toDF(*docs.columns, "quality_score")

    def run(batches):
        for batch, texts in groups_by_size(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(texts, sent.value), pa.float64())], names=["key", "score"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")).mapInArrow(run, "key long, score double").withColumnRenamed("key", key)
