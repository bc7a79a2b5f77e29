"""Two-pass external shuffle into shards of equal row counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, batched, small, table

#: Bytes of a bucket.  A task holds a bucket and its permuted copy; the order follows the buckets, so their size is never taken from a cluster's memory.
BUCKET_BYTES = 64 << 20


def external_shuffle(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs in a seeded random order, dealt into shards: every column, and ``shard``, ``slot``.

    Pass one scatters rows uniformly into buckets of about bucket_bytes by a seeded hash of id and
    text.  A bucket that comes out over twice that size is split by another hash, and by row position
    if it holds many copies of one row (only then does the order depend on the input's layout; the input is staged first, so
    that a recomputed task sees the same rows).  Pass
    two holds one bucket at a time, permutes it (Fisher-Yates with a generator seeded by seed and
    bucket, over rows in a fixed order) and writes it to the shared folder.  A row's place in the
    sequence of all buckets is g: shard g mod n_shards, slot g div n_shards.  So shard counts differ
    by one at most and slots have no gaps, however skewed sources, keys and copies are.

    Nulls in id or text are values like others; an empty table gives an empty result; repeated rows
    are rows of their own.  A column called shard or slot in docs is replaced; other columns may have any name.

    But for such copies the same rows, seed, shards and bucket_bytes give the same order on any cluster.

    The driver holds three numbers; counts of buckets stay in tables, a row a bucket.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession, "shuffle")
    batched(spark, 2000)
    docs = docs.drop("shard", "slot")
    fields, id_, text = docs.schema.fields, docs.columns.index(id_col), docs.columns.index(text_col)
    columns = [f"c{k}" for k in range(len(fields))]
    docs = docs.toDF(*columns)
    size = F.coalesce(F.octet_length(columns[text]), F.lit(0)) + 64
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col(columns[id_]).cast("string"), F.lit("-")), F.coalesce(F.col(columns[text]), F.lit("-")))
    n = max(1, -(-(docs.agg(F.sum(size)).first()[0] or 0) // bucket_bytes))
    homed = lambda d: d.withColumn("hashed", hashed).withColumn("home", F.pmod("hashed", F.lit(n)).cast("int"))
    rows = homed(docs)
    over = work.stage(rows.groupBy("home").agg(F.sum(size).alias("b")).filter(F.col("b") > 2 * bucket_bytes), "over")
    within = rows.join(small(over), "home").groupBy("home", "b", "hashed").agg(F.count("*").alias("n")).groupBy("home", "b").agg((F.sum("n") > 2 * F.count("*")).alias("copies"))
    parts = F.ceil(F.col("b") / bucket_bytes)
    before = F.sum("parts").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1))
    split = work.stage(within.withColumn("parts", parts).withColumn("base", n + F.coalesce(before, F.lit(0))), "split")
    extra, hot = split.agg(F.sum("parts"), F.max("copies")).first()
    if hot:
        rows = homed(work.stage(docs, "input"))
    again = F.when(F.col("copies"), F.xxhash64("hashed", F.monotonically_increasing_id())).otherwise(F.xxhash64("hashed"))
    moved = F.when(F.col("parts").isNull(), F.col("home")).otherwise(F.col("base") + F.pmod(again, F.col("parts"))).cast("int")
    keyed = rows.join(F.broadcast(split.drop("b")), "home", "left").select(*columns, "hashed", moved.alias("bucket"))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        order, homes = whole["hashed"].to_numpy(), whole["bucket"].to_numpy()
        for k in np.unique(homes).tolist():
            at = np.flatnonzero(homes == k)
            at = at[np.argsort(order[at], kind="stable")]
            np.random.default_rng([seed, k]).shuffle(at)
            for i in range(0, len(at), 2000):
                part = whole.take(pa.array(at[i : i + 2000])).select(columns)
                part = part.append_column("bucket", pa.array(np.full(part.num_rows, k, np.int32))).append_column("place", pa.array(np.arange(i, i + part.num_rows, dtype=np.int64)))
                yield from part.combine_chunks().to_batches()

    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(columns, fields, strict=True)), T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType())])
    written = work.stage(keyed.repartitionById(int(n + (extra or 0)), F.col("bucket")).mapInArrow(permute, schema), "buckets")
    start = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = work.stage(written.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", start.alias("start")), "offsets")
    work.drop("over", "split", "input")
    g = F.col("start") + F.col("place")
    out = written.join(small(offsets), "bucket").select(*columns, F.pmod(g, F.lit(n_shards)).cast("int"), F.floor(g / n_shards).cast("long"))
    return out.toDF(*(f.name for f in fields), "shard", "slot")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents into 40 shards whose row counts differ by one at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = external_shuffle(docs, 40)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
