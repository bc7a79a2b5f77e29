"""A corpus pipeline over documents: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsieve.llm.common import Work, row_key, small, table
from graphsieve.llm.decontaminate import contamination
from graphsieve.llm.lines import drop_frequent_lines
from graphsieve.llm.minhash import near_duplicates
from graphsieve.llm.packing import packed
from graphsieve.llm.quality import apply_rules, train_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees' verdict.  Null, empty and short texts fail; repeated rows pass or fail together."""
    model = train_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, model, keep_columns=COLUMNS).filter("kept").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten documents or more; n_chars follows, a null text stays null."""
    out = drop_frequent_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similarity 0.8 or more: the one of the smallest id.

    Rows are judged by their own text, also where an id has several; of rows with equal id and text one stays, the least
    by its other columns.  Null and empty texts, and rows without id, are in no group.
    """
    work = Work(spark, "near")
    verdicts = near_duplicates(docs, percent=80)
    gone = work.stage(verdicts.filter(~F.col("stays")).select("row").distinct(), "gone")
    again = work.stage(verdicts.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row"), "again")
    left = docs.select(COLUMNS).withColumn("row", row_key("doc_id", "text")).join(small(gone), "row", "left_anti")
    one = left.join(small(again), "row", "left_semi").groupBy("row").agg(F.min(F.struct("lang", "source", "n_chars")).alias("c"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return left.join(small(again), "row", "left_anti").select(COLUMNS).unionByName(one.select("doc_id", "text", "c.lang", "c.source", "c.n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items cover less than a twentieth.  Null and empty texts are clean; repeated rows stay or go together."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in bins.  Null and empty texts are items of size 1, repeated rows items of their own."""
    return packed(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicate", near_duplicate), ("decontaminate", decontaminate), ("packing", packing)]
#: The boosted trees and the bins' order are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.stage(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
