"""Work folders, staged tables and expressions shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import shared_folder
from ..ship import ship

#: Rows of an Arrow batch handed to Python; texts of usual length then make a few MB.
BATCH_ROWS = 1000
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Work:
    """A folder under the shared root for an operator's intermediate tables.

    A staged table is written by Spark's committer and read again: it cuts lineage and survives
    lost executors.  ``drop`` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}", compression="zstd")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def batched(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Readies the session for Python stages: they find this package, and hold batches of so many rows at most."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over each non-empty batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z as a-z and nothing else; pure ASCII takes the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(*cols: Column | str) -> Column:
    """A 128-bit key of a row's values, nulls and borders told apart."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) if isinstance(c, str) else c for c in cols]
    return F.unhex(F.md5(F.concat(*parts)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def kept(df: DataFrame) -> list[Column]:
    """All columns of df, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Bytes of a staged table's files up to which it is broadcast.
MAX_BROADCAST = 8 << 20


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of df's size without a job: of a staged table, or less of it, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """df (staged, or an aggregate or a selection of staged rows) for a broadcast if its files are small, else as it is: a shuffled join, which AQE can split."""
    return F.broadcast(df) if bytes_of(df) <= MAX_BROADCAST else df


def parts_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for rows that cost far more than their bytes tell AQE."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(rows: int, of: int, *cols: Column | str) -> Column:
    """Whether a row is of a sample of about so many rows, by a hash of cols; any share of any size is kept (63 bits)."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1)) / float(1 << 63)) < F.lit(min(1.0, rows / max(of, 1)))


def held_out(part: int, rest: int) -> Column:
    """crc32 of the id as text, modulo part, is rest; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(part)) == rest
