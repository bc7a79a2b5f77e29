"""Best-fit packing of documents into sequences, with conflicts."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import batched, map_arrow, table

CAPACITY = 2048
GROUP = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each item, taken in the order given; no bin has two items of one source or one cluster.

    Bins are ordered by residual and carry a bitmap of their sources and one of their clusters.  For
    an item the search starts at the least residual that holds it and goes on to the successor
    until a bin has neither bit set: the tightest compatible bin.  None: a new bin.  A None source or
    cluster conflicts with nothing.
    """
    source_bit, cluster_bit = {None: 0}, {None: 0}
    order: list[tuple[int, int]] = []  # (residual, bin)
    in_sources: list[int] = []
    in_clusters: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        sb = source_bit.setdefault(source, 1 << len(source_bit))
        cb = cluster_bit.setdefault(cluster, 1 << len(cluster_bit))
        i = bisect.bisect_left(order, (size, -1))
        while i < len(order) and (in_sources[order[i][1]] & sb or in_clusters[order[i][1]] & cb):
            i += 1
        if i < len(order):
            left, k = order.pop(i)
        else:
            left, k = capacity, len(in_sources)
            in_sources.append(0), in_clusters.append(0)
        out.append((k, capacity - left))
        in_sources[k] |= sb
        in_clusters[k] |= cb
        if left > size:
            bisect.insort(order, (left - size, k))
    return out


def measure(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, size, source, cluster) of every row: words and one for the separator; cluster is a hash of the words.

    A null or empty text, or one without words, has size 1 and no cluster; repeated rows are rows of their own.
    """
    batched(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, cluster = [], []
        for _, _, data, offs in K.chunks(batch["text"]):
            words = K.Words(data, offs)
            size.append(words.counts + 1)
            place = np.arange(len(words.rows)) - words.first[words.rows]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(words.hashes + K.mix(place.astype(np.uint64))))))
            cluster.append(K.mix(sums[words.first[1:]] - sums[words.first[:-1]]).view(np.int64))
        size, cluster = np.concatenate(size), np.concatenate(cluster)
        return pa.record_batch({"id": batch["id"], "size": pa.array(size), "source": batch["source"], "cluster": pa.array(cluster, mask=size == 1)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "id long, size long, source string, cluster long")


def pack(items: DataFrame, rows: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(id, piece, first, size, bin, start) of items (id, size, source, cluster), rows in number.

    Items longer than the capacity are cut: full pieces fill bins of their own, the rest is packed
    like other items.  Items are dealt by a seeded hash into groups of about ``group`` rows, whatever
    their source, and each group is packed by decreasing size (``best_fit``); a bin is named by group
    and number, and a bin's items start one after another.  Tasks hold one group; a repeated row is an
    item of its own: equal rows are counted and numbered, and dealt apart by their numbers.  So bins depend on the
    rows only, not on their order or partitions.

    Sizes under 1 count as 1, a null source or cluster conflicts with nothing, and an empty table
    gives an empty result.
    """
    batched(items.sparkSession)
    sized = items.select("id", F.greatest(F.coalesce("size", F.lit(1)), F.lit(1)).cast("long").alias("size"), "source", "cluster")
    last = F.floor((F.col("size") - 1) / capacity).cast("int")
    each = sized.groupBy("id", "size", "source", "cluster").agg(F.count("*").alias("n"))
    sized = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("first", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("size") - F.col("first")).cast("long"))
    groups = max(1, -(-rows // group))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.lit(23), "id", "source", "cluster", "piece", "copy"), F.lit(groups)).cast("long"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "id", "piece", "source", "cluster", "copy"], ascending=[False, True, True, True, True, True], kind="stable")
        none = lambda c: [None if pd.isna(x) else x for x in frame[c]]
        got = best_fit(frame["size"].tolist(), none("source"), none("cluster"), capacity)
        number = np.array([x[0] for x in got], np.int64)
        frame["bin"], frame["start"] = (frame["g"].to_numpy() << 24) + number, [x[1] for x in got]
        return frame[["id", "piece", "first", "size", "bin", "start"]]

    return dealt.groupBy("g").applyInPandas(fill, "id long, piece int, first long, size long, bin long, start long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in bins of 2,048 words, no two of a source or of equal words in one."""
    return packed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def packed(docs: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """pack of documents, in their terms: (doc_id, piece, first_word, n_tokens, bin, bin_start).

    clusters (doc_id, cluster: long) names near copies, as near_duplicates finds them; a document that is in none has the cluster
    of its words.  Nulls, empty texts, repeated rows and empty tables: see measure and pack.
    """
    items = measure(docs)
    if clusters is not None:
        given = clusters.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("cluster").cast("long").alias("_given"))
        items = items.join(given, "id", "left").withColumn("cluster", F.coalesce("_given", "cluster")).drop("_given")
    return pack(items, docs.count()).select(F.col("id").alias("doc_id"), "piece", F.col("first").alias("first_word"), F.col("size").alias("n_tokens"), "bin", F.col("start").alias("bin_start"))
