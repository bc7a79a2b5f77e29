"""Fixpoint loops over DataFrames, and row numbers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, one machine's session (``local[...]``, as in tests) gets a folder of its own; on a cluster a
    machine-local folder would lose results, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphsieve-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and written to the cluster's checkpoint folder, lineage cut."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Rows that a task groups by keys which hardly repeat.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """df (of so many rows, about) by its keys in as many tasks as the rows need, two at least: what a task groups doesn't grow with the table.

    The session's number of partitions is fixed, and AQE only makes fewer of them.  Where keys hardly repeat, a grouping before
    the shuffle would hold its input's rows once more; after this there is none.
    """
    return df.repartition(max(2, -(-rows // task_rows)), *keys)


def repeat(state: DataFrame, step: Callable[[DataFrame], DataFrame], times: int, every: int = 5) -> DataFrame:
    """step applied times over, checkpointed every few steps."""
    for k in range(1, times + 1):
        state = step(state)
        if k % every == 0 and k < times:
            state = checkpointed(state)
    return state


def placed(df: DataFrame, *order: str, place: str = "place") -> DataFrame:
    """df with its row numbers from 0 in the given order (which should be total), without bringing all rows into one task.

    Rows are dealt and sorted by range; a row's number is its number within its range plus the rows of the
    ranges before, of which there are as many as partitions.
    """
    at = F.monotonically_increasing_id()
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_before"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(place, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def ranked(df: DataFrame, group: list[str], *order: str) -> DataFrame:
    """df with _k, its row number from 1 within its group by order, _m, the group's rows, _range and _group: no group need fit one task.

    Rows are dealt and sorted by group, order and place of input, so a very large group, or very many equal values, spread over ranges;
    a row's number is its number within its range and group plus the group's rows in the ranges before (a row a range and group).
    """
    name = F.to_json(F.struct(*group)) if group else F.lit("")
    at = F.monotonically_increasing_id()
    keyed = df.withColumns({"_group": name, "_tie": at})
    keys = ["_group", *order, "_tie"]
    ranged = checkpointed(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = ranged.groupBy("_group", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_group", "_range", "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy("_group")).alias("_m"))
    return ranged.join(parts, ["_group", "_range"]).withColumn("_k", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_first", "_before")
