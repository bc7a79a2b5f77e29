"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import batched, held_out, kept, map_arrow, table

ORDERS = (1, 2, 3)
DIMS = 1 << 15
MAX_PER_LANG = 4000
#: Languages a model may have: its matrix has a row of 128 kB for each.
MAX_LANGS = 2000
#: Numbers gathered at once in scoring.
BLOCK = 1 << 22


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of a chunk of texts: buckets, bounds of each row's buckets, and whether a row has a letter.

    A-Z count as a-z; everything but letters counts as a space, and runs of spaces as one.
    """
    lead = (data & 0xC0) != 0x80
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    at = np.concatenate(([0], np.cumsum(lead)))[offs]
    letter = _letters()[chars]
    has = np.diff(np.concatenate(([0], np.cumsum(letter)))[at]) > 0
    upper = (chars >= 65) & (chars <= 90)
    chars[upper] += 32
    chars[~letter] = 32
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    keep = np.ones(len(chars), bool)
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    chars, row = chars[keep].astype(np.uint64), row[keep]
    buckets, rows = [], []
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + chars[k : k + m]
        inside = row[:m] == row[n - 1 :]
        buckets.append((K.mix(h[inside]) >> np.uint64(64 - 15)).astype(np.int32))
        rows.append(row[:m][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64), has
    buckets, rows = np.concatenate(buckets), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return buckets[order], np.searchsorted(rows[order], np.arange(len(offs))), has


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_per_lang: int = MAX_PER_LANG, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (languages x (DIMS + 1), the prior last).

    Of each language about max_per_lang documents at most are counted, taken by a hash of their id (of languages with
    millions of documents and more too); the driver gets 16 partial count vectors a language.  Null languages and texts are left out;
    without labelled texts there are no languages.  More than MAX_LANGS languages raise ValueError: the column is no language label.
    """
    spark = docs.sparkSession
    batched(spark)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"{lang_col} has more than {MAX_LANGS} values")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, DIMS + 1))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_per_lang / sizes[lang]))])
    mark = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 63) - 1)) / float(1 << 63)
    sample = rows.filter(mark < share[F.col("lang")]).select("lang", "text").repartition(16)
    place = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), DIMS), np.int64)
        for batch in batches:
            which = np.array([place[x] for x in batch["lang"].to_pylist()], np.int64)
            for i, j, data, offs in K.chunks(batch["text"]):
                buckets, bounds, _ = features(data, offs)
                flat = np.repeat(which[i:j], np.diff(bounds)) * DIMS + buckets
                total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        for k in np.flatnonzero(total.any(axis=1)).tolist():
            yield pa.record_batch({"lang": pa.array([langs[k]]), "counts": pa.array([total[k]], pa.list_(pa.int64()))})

    counts = np.full((len(langs), DIMS), smoothing)
    for r in sample.mapInArrow(count, "lang string, counts array<long>").toLocalIterator():
        counts[place[r["lang"]]] += np.array(r["counts"])
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    prior = np.array([sizes[x] for x in langs], float)
    return langs, np.column_stack([logs, np.log(prior / prior.sum())])


def scores(weights: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log posteriors (rows x languages) of a batch: its n-grams' rows of the matrix summed by segments, so many rows at once that BLOCK numbers are gathered."""
    n, langs = len(bounds) - 1, weights.shape[1]
    out = np.tile(weights[-1].astype(np.float64), (n, 1))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK // langs, "right")) - 1)
        full = np.flatnonzero(np.diff(bounds[i : j + 1])) + i
        if j == i + 1 and len(full) and bounds[j] - bounds[i] > BLOCK // langs:  # a very long text: each n-gram once, by its number
            hit, times = np.unique(buckets[bounds[i] : bounds[j]], return_counts=True)
            out[i] += times @ weights[hit].astype(np.float64)
        elif len(full):
            out[full] += np.add.reduceat(weights[buckets[bounds[i] : bounds[j]]], bounds[full] - bounds[i], axis=0, dtype=np.float64)
        i = j
    return out


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``, the posterior of the language predicted.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned.  Ties
    go to the language first in order.  An empty table gives an empty result; columns of the names
    added are replaced.
    """
    spark = docs.sparkSession
    batched(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    matrix = spark.sparkContext.broadcast(np.ascontiguousarray(logs.T.astype(np.float32)))
    n = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = [], []
        for _, _, data, offs in K.chunks(batch.column(n)):
            buckets, bounds, has = features(data, offs)
            if not langs:
                pred += ["und"] * len(has)
                score.append(np.zeros(len(has)))
                continue
            per = scores(matrix.value, buckets, bounds)
            top = per.argmax(axis=1)
            odds = np.exp(per - per.max(axis=1, keepdims=True))
            pred += [langs[k] if ok else "und" for k, ok in zip(top.tolist(), has.tolist(), strict=True)]
            score.append(np.where(has, 1 / odds.sum(axis=1), 0.0))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(pred, pa.string()), pa.array(np.concatenate(score))], names=schema.names)

    return map_arrow(docs.select(*kept(docs), F.col(text_col)).toDF(*(f"c{k}" for k in range(n + 1))), label, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(4, 2)
    langs, logs = train(docs.filter(~held))
    out = predict(docs.select("doc_id", "text", held.alias("held_out")), langs, logs)
    return out.select("doc_id", "held_out", "lang_pred", "score")
