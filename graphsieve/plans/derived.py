"""The graph and the entity sets that the queries take from the star-schema tables.

Suppliers and parts are nodes (s1, p1), their order lines edges scored by number; two thresholds play the
two confidence levels.  Prices and balances are expression.  Parts of one brand and of six brands are the small
and the large target set, small parts the disease set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import dealt

LOOSE, STRICT = 2, 3
SMALL, LARGE = ["Brand#1"], [f"Brand#{k}" for k in range(2, 8)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def n_lines(spark: SparkSession, sf: str) -> int:
    """Order lines, by the files' footers."""
    return table(spark, sf, "lineitem").count()


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, score) of all pairs, of which there are nearly as many as order lines."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    li = dealt(li, n_lines(spark, sf), "l_suppkey", "l_partkey")
    ends = [F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")]
    return li.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("score")).select(*ends, "score")


def part_node() -> Column:
    return F.concat(F.lit("p"), F.col("p_partkey"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """(compound, node)."""
    p = table(spark, sf, "part")
    compound = F.when(F.col("p_brand").isin(SMALL), "A").when(F.col("p_brand").isin(LARGE), "B")
    return p.select(compound.alias("compound"), part_node().alias("node")).filter("compound is not null")


def disease(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter("p_size <= 5").select(part_node().alias("node"))


def expression(spark: SparkSession, sf: str) -> DataFrame:
    """(node, x)."""
    p = table(spark, sf, "part").select(part_node().alias("node"), F.col("p_retailprice").alias("x"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.greatest("s_acctbal", F.lit(0.0)).alias("x"))
    return p.unionAll(s)
