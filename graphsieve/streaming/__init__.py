"""Incremental graph building from a stream of scored links.

The batch operators have no stream counterpart to match; this keeps an edge table current as link files
arrive, which is the one place where the pipeline's input grows by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import canonical


def read_links(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (src, dst, score) from Parquet files added to a folder."""
    return spark.readStream.schema("src string, dst string, score long").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_edges(links: DataFrame, path: str, checkpoint: str, min_score: float) -> StreamingQuery:
    """Writes each batch's canonical edges as a run of its own; a batch that is run again replaces its run."""

    def put(batch: DataFrame, number: int) -> None:
        canonical(batch, min_score).write.mode("overwrite").parquet(f"{path}/run={number}")

    return links.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, score): the best score of each pair over all runs."""
    return spark.read.parquet(path).groupBy("src", "dst").agg(F.max("score").alias("score"))
