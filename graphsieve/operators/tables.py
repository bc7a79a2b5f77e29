"""Relational steps of the curation: mapping, filtering, keeping one row, membership and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .iterate import placed


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (which should be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_value(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, value): the value of the greatest ordinal, as when later rows overwrite earlier ones."""
    return df.groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def map_ids(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """raw (protein_id, ...) with gene_name (null: no mapping), its standard symbol and ``foreign``."""
    named = raw.join(mapping.select("protein_id", C.standardise(F.col("gene_name")).alias("gene_name")), "protein_id", "left")
    return named.withColumn("foreign", F.col("gene_name").isNotNull() & C.is_non_human(F.col("protein_id"), F.col("gene_name")))


def curate(raw: DataFrame, mapping: DataFrame, order: list[Column]) -> DataFrame:
    """(compound, protein_id, source, gene_name): mapped human rows, the first of each compound and accession."""
    good = map_ids(raw, mapping).filter(F.col("gene_name").isNotNull() & ~F.col("foreign"))
    return keep_first(good, ["compound", "protein_id"], order).select("compound", "protein_id", "source", "gene_name")


def curation_audit(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """(compound, n_raw, n_unmapped, n_foreign, n_kept, n_duplicates): n_kept before repeated accessions go, of which there are n_duplicates."""
    good = F.col("gene_name").isNotNull() & ~F.col("foreign")
    return map_ids(raw, mapping).groupBy("compound").agg(
        F.count("*").alias("n_raw"), F.count_if(F.col("gene_name").isNull()).alias("n_unmapped"), F.count_if("foreign").alias("n_foreign"),
        F.count_if(good).alias("n_kept"), (F.count_if(good) - F.count_distinct(F.when(good, F.col("protein_id")))).alias("n_duplicates"),
    )


def exclusion_trace(raw: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """Every raw row with its number within the compound, reason and species.

    Numbers come from row numbers over all rows, so a compound with a large share of them is no task of its own.
    """
    m = placed(map_ids(raw, mapping), "compound", order, "protein_id", place="_place")
    first = m.groupBy(F.col("compound").alias("_compound")).agg(F.min("_place").alias("_first"))
    gene, acc = F.col("gene_name"), F.col("protein_id")
    return m.join(first, F.col("compound").eqNullSafe(F.col("_compound"))).select(
        "compound", (F.col("_place") - F.col("_first") + 1).cast("int").alias("idx"), "protein_id", F.coalesce(gene, F.lit("NO_MAPPING")).alias("gene"),
        C.curation_reason(gene.isNotNull() & ~F.col("foreign"), gene, F.col("foreign")).alias("reason"), F.when(F.col("foreign"), C.species(acc, gene)).alias("species"),
    )


def placeholder(df: DataFrame) -> DataFrame:
    """gene_name filled by UNMAPPED_ and the accession."""
    return df.withColumn("gene_name", F.coalesce("gene_name", F.concat(F.lit("UNMAPPED_"), "protein_id")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def with_flags(df: DataFrame, key: str, **sets: DataFrame) -> DataFrame:
    """df with a boolean column for each set (node): whether key is in it."""
    for name, nodes in sets.items():
        df = df.join(nodes.select(F.col("node").alias(key)).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").distinct().join(b.select("node"), "node", "left_anti")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").distinct().join(b.select("node"), "node", "left_semi")


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (subset, strict, equal)."""
    missing = only_in(a, b).agg(F.count("*").alias("x"))
    extra = only_in(b, a).agg(F.count("*").alias("y"))
    return missing.crossJoin(extra).select((F.col("x") == 0).alias("subset"), ((F.col("x") == 0) & (F.col("y") > 0)).alias("strict"), ((F.col("x") == 0) & (F.col("y") == 0)).alias("equal"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its row numbers from 0 by order, counted by range."""
    return placed(df, order, place=name)
