"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import batched, held_out, kept, map_arrow, table
from .quality import FEATURES, bounded_labels, statistics

PASSAGE_WORDS = 100
HASHED = 256
INPUTS = len(FEATURES) + HASHED
#: Of the training sample: documents, and passages of a document (evenly spaced).
MAX_TRAIN, MAX_PASSAGES = 4000, 64


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of every passage (passages x INPUTS) and the first passage of each row.

    A passage is PASSAGE_WORDS words with what stands between them; a row without words is one
    passage.  Inputs are the passage's statistics and its words' signed hash counts by length.
    """
    words = K.Words(data, offs)
    n = len(offs) - 1
    place = np.arange(len(words.starts)) - words.first[words.rows]
    cut = (place % PASSAGE_WORDS == 0) & (place > 0)
    row = np.concatenate((np.arange(n), words.rows[cut]))
    byte = np.concatenate((offs[:-1], words.starts[cut]))
    order = np.lexsort((byte, row))
    row, byte = row[order], byte[order]
    bounds = np.append(byte, len(data))
    _, stats = statistics(data, bounds)
    owner = np.searchsorted(row, words.rows, "left") + place // PASSAGE_WORDS
    sign = np.where(words.hashes >> np.uint64(63), 1.0, -1.0)
    slot = (words.hashes & np.uint64(HASHED - 1)).astype(np.int64)
    hashed = np.bincount(owner * HASHED + slot, weights=sign, minlength=len(row) * HASHED).reshape(len(row), HASHED)
    size = np.maximum(np.bincount(owner, minlength=len(row)), 1)[:, None]
    return np.hstack([stats, hashed / np.sqrt(size)]), np.searchsorted(row, np.arange(n))


@dataclass
class Mil:
    """Encoder h = tanh(x E), attention a = softmax((tanh(h V) * sigmoid(h U)) w), score = sigmoid((sum a h) c + d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones((len(x), 1))])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each document by itself: a product over a whole batch may differ in the last digits by a row's place in it."""
        x, one = self.inputs(x), np.zeros(1, np.int64)
        return np.round([_forward(x[a:b], one, self.weights)[-1][0] for a, b in zip(first, np.append(first[1:], len(x)), strict=True)], 9)


def _forward(x: np.ndarray, first: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    e, v, u, w, c = weights
    h = np.tanh(x @ e)
    t, s = np.tanh(h @ v), 1 / (1 + np.exp(-h @ u))
    raw = (t * s) @ w
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    a = np.exp(raw - np.maximum.reduceat(raw, first)[of])
    a /= np.add.reduceat(a, first)[of]
    z = np.add.reduceat(a[:, None] * h, first)
    p = 1 / (1 + np.exp(-np.clip(z @ c[:-1] + c[-1], -30, 30)))
    return h, t, s, of, a, z, p


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 11, hidden: int = 24, gate: int = 12, epochs: int = 40, size: int = 256, rate: float = 0.01, decay: float = 1e-4) -> Mil:
    """Adam on the log loss of document labels, through the attention, in batches of documents."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(INPUTS), np.ones(INPUTS))
    weights = [rng.normal(0, d**-0.5, (d, k)) for d, k in ((INPUTS + 1, hidden), (hidden, gate), (hidden, gate))] + [rng.normal(0, gate**-0.5, gate), np.zeros(hidden + 1)]
    model = Mil(mean, scale, weights)
    if not len(y):
        return model
    rate0 = np.clip(y.mean(), 0.01, 0.99)
    weights[4][-1] = np.log(rate0 / (1 - rate0))
    xs, last = model.inputs(x), np.append(first, len(x))
    m, q, step = [np.zeros_like(k) for k in weights], [np.zeros_like(k) for k in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), size):
            docs = order[i : i + size]
            lens = last[docs + 1] - last[docs]
            begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
            rows = np.arange(lens.sum()) - np.repeat(begin - last[docs], lens)
            b = xs[rows]
            e, v, u, w, c = weights
            h, t, s, of, a, z, p = _forward(b, begin, weights)
            g = (p - y[docs]) / len(docs)
            gz = g[:, None] * c[:-1]
            gc = np.append(z.T @ g, g.sum())
            ga = (gz[of] * h).sum(axis=1)
            graw = a * (ga - np.add.reduceat(a * ga, begin)[of])
            gh = a[:, None] * gz[of]
            gw = (t * s).T @ graw
            gts = graw[:, None] * w
            gt, gs = gts * s * (1 - t * t), gts * t * s * (1 - s)
            gh += gt @ v.T + gs @ u.T
            grads = [b.T @ (gh * (1 - h * h)), h.T @ gt, h.T @ gs, gw, gc]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + decay * weights[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                q[k] = 0.999 * q[k] + 0.001 * grad * grad
                weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", max_train: int = MAX_TRAIN, max_passages: int = MAX_PASSAGES) -> Mil:
    """A model of the labels (doc_id, label_col) over about max_train labelled documents at most.

    Of each up to max_passages passages, evenly spaced, go to the driver, so long texts are bounded too.  Null ids and
    labels are left out, of unlike labels of one id the least holds; without labels the score is a constant.
    """
    batched(docs.sparkSession)
    chosen = bounded_labels(labels, label_col, max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, _, data, offs in K.chunks(batch["text"]):
            x, first = passages(data, offs)
            out += [a[np.unique(np.linspace(0, len(a) - 1, min(len(a), max_passages)).astype(int))].ravel().astype(np.float32) for a in np.split(x, first[1:])]
        return pa.record_batch({"doc_id": batch["doc_id"], "label": batch["label"], "x": pa.array(out, pa.list_(pa.float32()))})

    got = map_arrow(rows.select("doc_id", "text", "label"), encode, "doc_id long, label int, x array<float>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return fit(np.zeros((0, INPUTS)), np.zeros(0, np.int64), np.zeros(0))
    x = got["x"].combine_chunks()
    lens = np.diff(x.offsets.to_numpy()) // INPUTS
    return fit(x.flatten().to_numpy().reshape(-1, INPUTS), np.concatenate(([0], np.cumsum(lens)[:-1])), got["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Mil, text_col: str = "text") -> DataFrame:
    """docs with ``score``, the probability of label 1.

    Null and empty texts are one empty passage and get that passage's score; rows are scored one by
    one, to nine digits, so repeated rows get equal scores; an empty table gives an empty result; a column called
    score is replaced.
    """
    batched(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "score"])
    n, schema = len(docs.columns), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = [model.score(*passages(data, offs)) for _, _, data, offs in K.chunks(batch.column(n))]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(np.concatenate(p))], names=schema.names)

    return map_arrow(docs.select(*kept(docs), F.col(text_col)).toDF(*(f"c{k}" for k in range(n + 1))), run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels are learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    out = score(docs.withColumn("held_out", held_out(5, 0)), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
