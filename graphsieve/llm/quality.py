"""Quality rules: base document statistics and a gradient-boosted verdict over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import batched, map_arrow, sampled, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Document statistics and the sign their effect on quality may have (0: any).
FEATURES = {
    "log_words": 0, "word_chars_mean": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "shout_rate": -1, "bar_rate": -1,
    "digit_rate": 0, "stop_rate": 0, "line_rate": 0, "distinct_rate": 0, "short_rate": 0, "other_rate": 0, "mixed_rate": 0, "query_rate": 0,
}
MAX_TRAIN = 20_000


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS = _is(b"#*$%&|<>")
_UPPER, _LOWER_, _DIGIT = _is(bytes(range(65, 91))), _is(bytes(range(97, 123))), _is(bytes(range(48, 58)))
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_OTHER = _is(bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,#*$%&|<>!?"))


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (rows x 5, int64) and the features (rows x 16, float64) of a chunk of texts."""
    n = len(offs) - 1
    words = K.Words(data, offs, fold=False)
    per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offs])  # noqa: E731  set flags of each row
    lead = _LEAD[data]
    in_words = K.SPACE_WORDS[data]
    word_chars, symbols = per(in_words & lead), per(_SYMBOLS[data])
    starts, ends, rows = K.runs_of(data != 10, offs)
    worded = np.concatenate(([0], np.cumsum(in_words)))
    full = worded[ends] > worded[starts]
    starts, ends, rows = starts[full], ends[full], rows[full]
    lines = np.bincount(rows, minlength=n)
    keys = K.span_hashes(data, starts, ends, fold=False) + _row_salt(rows)  # equal only within a row
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    dup_lines = np.bincount(rows[order[same]], minlength=n)
    repeat = _repeat_words(words, n)
    distinct = _distinct(words, n)
    lengths = words.ends - words.starts
    w, c = np.maximum(words.counts, 1), np.maximum(word_chars, 1)
    per_word = lambda flags: np.bincount(words.rows[flags], minlength=n) / w
    upper, lower = per(_UPPER[data]), per(_LOWER_[data])
    first = data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    caps = np.concatenate(([0], np.cumsum(_UPPER[data])))
    inner_caps = (caps[words.ends] - caps[words.starts] - _UPPER[first]) > 0
    features = np.column_stack([
        np.log1p(words.counts), word_chars / w, symbols / c, dup_lines / np.maximum(lines, 1), repeat / w, upper / np.maximum(upper + lower, 1), per(data == 33) / w, per(data == 124) / w,
        per(_DIGIT[data]) / c, (per(data == 46) + per(data == 44)) / w, lines / w, distinct / w, per_word(lengths <= 3), per(_OTHER[data]) / c, per_word(inner_caps), per(data == 63) / w,
    ]) if n else np.zeros((0, len(FEATURES)))
    return np.column_stack([words.counts, word_chars, symbols, dup_lines, repeat]).astype(np.int64), features


def _row_salt(rows: np.ndarray) -> np.ndarray:
    return K.mix(rows.astype(np.uint64) + np.uint64(1))


def _repeat_words(words: K.Words, n: int, width: int = 5) -> np.ndarray:
    """Words that stand in a window of width words found twice or more in their text."""
    if len(words.hashes) < width:
        return np.zeros(n, np.int64)
    keys = K.windows(words.hashes, width)
    m = len(keys)
    inside = words.rows[:m] == words.rows[width - 1 :]
    keys = (keys + _row_salt(words.rows[:m]))[inside]
    at = np.flatnonzero(inside)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    hit = at[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    edge[hit] += 1
    np.subtract.at(edge, hit + width, 1)
    return np.bincount(words.rows[np.cumsum(edge[:-1]) > 0], minlength=n)


def _distinct(words: K.Words, n: int) -> np.ndarray:
    order = np.argsort(words.hashes + _row_salt(words.rows))
    keys = (words.hashes + _row_salt(words.rows))[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount(words.rows[order[new]], minlength=n)


@dataclass
class Trees:
    """Complete binary trees as node arrays: trees x inner nodes, trees x leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
            total += self.leaf[t][node - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: float = 1.0) -> Trees:
    """Newton boosting of the log loss on binned features.

    Where signs[f] is -1 (1), no tree's output rises (falls) with feature f: a split on f whose child
    values go the other way is not made, and both children's later values stay on their side of the
    middle.  Without both labels in y the result is a constant.
    """
    p = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    margin = np.full(len(y), out.bias)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        node, lo, hi = np.zeros(len(y), np.int64), np.array([-np.inf]), np.array([np.inf])
        for d in range(depth):
            width, base = 2**d, 2**d - 1
            best = np.full(width, 1e-9)
            pick, cut = np.zeros(width, np.int64), np.full(width, -1)
            left_value, right_value = np.zeros(width), np.zeros(width)
            for f, (c, b) in enumerate(zip(cuts, binned, strict=True)):
                m = len(c) + 1
                gs, hs = (np.cumsum(np.bincount(node * m + b, weights=v, minlength=width * m).reshape(width, m), axis=1) for v in (g, h))
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                vl = np.clip(-gl / (hl + ridge), lo[:, None], hi[:, None])
                vr = np.clip(-(gt - gl) / (ht - hl + ridge), lo[:, None], hi[:, None])
                v0 = np.clip(-gt / (ht + ridge), lo[:, None], hi[:, None])
                loss = lambda v, gg, hh: gg * v + 0.5 * (hh + ridge) * v * v
                gain = loss(v0, gt, ht) - loss(vl, gl, hl) - loss(vr, gt - gl, ht - hl)
                gain[(hl < least) | (ht - hl < least) | (signs[f] * (vr - vl) < 0)] = -1
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], pick[better], cut[better] = top[better], f, k[better]
                left_value[better], right_value[better] = vl[np.arange(width), k][better], vr[np.arange(width), k][better]
            new_lo, new_hi = np.repeat(lo, 2), np.repeat(hi, 2)
            go = np.zeros(len(y), np.int64)
            for j in range(width):
                if cut[j] < 0:
                    continue
                out.feature[t, base + j], out.threshold[t, base + j] = pick[j], cuts[pick[j]][cut[j]]
                mine = node == j
                go[mine] = binned[pick[j]][mine] > cut[j]
                middle = (left_value[j] + right_value[j]) / 2
                if signs[pick[j]] > 0:
                    new_hi[2 * j], new_lo[2 * j + 1] = middle, middle
                elif signs[pick[j]] < 0:
                    new_lo[2 * j], new_hi[2 * j + 1] = middle, middle
            node, lo, hi = 2 * node + go, new_lo, new_hi
        gs, hs = (np.bincount(node, weights=v, minlength=leaves) for v in (g, h))
        out.leaf[t] = rate * np.clip(-gs / (hs + ridge), lo, hi)
        margin += out.leaf[t][node]
    return out


def bounded_labels(labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of about max_rows labelled documents at most, taken by a hash of doc_id; of unlike labels of one id the least holds."""
    clean = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    return clean.filter(sampled(max_rows, clean.count(), "doc_id", F.lit(5)))


def train_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> Trees:
    """Boosted trees for ``labels.quality`` over the statistics of at most about max_train labelled documents.

    That bound also holds for what is broadcast (ids) and what reaches the driver (16 doubles a row).
    Null ids and labels are left out, of unlike labels of one id the least holds; without labels every verdict is that of a constant.
    """
    chosen = bounded_labels(labels, "quality", max_train)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    batched(docs.sparkSession)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [statistics(data, offs)[1] for _, _, data, offs in K.chunks(batch["text"])]
        x = np.concatenate(parts)
        return pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), "label": batch["label"], "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})

    got = map_arrow(rows.select(F.col("doc_id").cast("long"), "text", "label"), measure, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    x = np.asarray(got["x"].combine_chunks().flatten() if got.num_rows else []).reshape(-1, len(FEATURES))
    return boost(x, got["label"].to_numpy().astype(float), np.array(list(FEATURES.values())))


def apply_rules(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.3, keep_columns: list[str] | None = None) -> DataFrame:
    """The columns of docs (or keep_columns of them) with the base counts, ``base_failed``, ``score`` and ``kept``.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows.  kept: not
    base_failed, and the trees give label 1 a probability of threshold or more.  A null text has no
    words (base_failed).  An empty table gives an empty result; rows are judged one by one, so
    repeated rows get equal verdicts.  Columns of the names added are replaced.
    """
    batched(docs.sparkSession)
    added = [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    names = [c for c in (docs.columns if keep_columns is None else keep_columns) if c.lower() not in {f.name for f in added}]
    columns = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{k}") for k, c in enumerate(names)]
    schema = T.StructType([docs.schema[c] for c in names] + added)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [statistics(data, offs) for _, _, data, offs in K.chunks(batch.column(len(names)))]
        base, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        score = model.score(x)
        failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
        new = [*(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *new], names=schema.names)

    return map_arrow(docs.select(*columns, F.col(text_col).alias("text")), judge, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the rules' verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, model, keep_columns=["doc_id"])
