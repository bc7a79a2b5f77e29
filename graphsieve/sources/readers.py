"""Scans: delimited files, expression matrices, gzip'd edge lists, JSON caches, Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

TARGETS = "compound string, protein_id string, source string"
GENES = "gene_name string, geneId long, score double, diseaseName string, diseaseId string"
#: Fixed value: the first line of a large-file pointer.
POINTER = "version https://git-lfs.github.com/spec"
#: Names of the severity list's columns.
SEVERITY = "LTKBID string, CompoundName string, SeverityClass string, LabelSection string, `vDILI-Concern` string, Comment string"


def is_pointer(spark: SparkSession, path: str) -> bool:
    """Whether the file is a large-file pointer instead of its content (only its first bytes are read)."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 100).cast("string").alias("h")).first()
    return head is not None and head["h"].startswith(POINTER)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_files(spark: SparkSession, paths: list[str]) -> None:
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(", ".join(missing))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that is there: a file and those that may stand in for it."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def many(spark: SparkSession, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Several CSV files by path, all of which must be there."""
    require_files(spark, list(schemas))
    return {p: csv(spark, p, s) for p, s in schemas.items()}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, gene_name) of lines of exactly two fields that aren't comments; the last of an id holds, aliases made standard."""
    lines = spark.read.text(path).withColumn("k", F.monotonically_increasing_id())
    f = F.split(F.trim("value"), ",", -1)
    rows = lines.filter(~F.col("value").startswith("#")).select("k", f.alias("f")).filter(F.size("f") == 2).select("k", F.col("f")[0].alias("protein_id"), C.standardise(F.col("f")[1]).alias("gene_name"))
    return rows.groupBy("protein_id").agg(F.max_by("gene_name", "k").alias("gene_name"))


def _gct(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Column names and (k, f): the fields of the rows after two preamble lines and the header, which is found by its first field."""
    lines = spark.read.text(path).withColumn("k", F.monotonically_increasing_id()).withColumn("f", F.split("value", "\t", -1))
    head = lines.filter(F.col("value").startswith("Name\t") | F.col("value").startswith("Description\t")).orderBy("k").first()
    if head is None:
        raise ValueError(f"no header in {path}")
    return list(head["f"]), lines.filter((F.col("k") > head["k"]) & (F.size("f") >= len(head["f"]))).select("k", "f")


def expression(spark: SparkSession, path: str, tissue: str = "Liver", at_least: float | None = None) -> DataFrame:
    """(gene, tpm): a tissue's column; the last row of a symbol holds, empty symbols and missing numbers are skipped.

    at_least drops rows below it before the last one is taken.  Without such a column: ValueError.
    """
    names, rows = _gct(spark, path)
    if tissue not in names:
        raise ValueError(f"no column {tissue}")
    symbol = F.col("f")[names.index("Description" if "Description" in names else "Name")]
    x = rows.select("k", symbol.alias("gene"), F.col("f")[names.index(tissue)].try_cast("double").alias("tpm")).filter("gene <> '' and tpm is not null and not isnan(tpm)")
    return (x if at_least is None else x.filter(F.col("tpm") >= at_least)).groupBy("gene").agg(F.max_by("tpm", "k").alias("tpm"))


def expressed(spark: SparkSession, path: str, pattern: str = "Liver", above: float = 1.0, inclusive: bool = False) -> DataFrame:
    """(gene): symbols whose median over all columns with pattern in their name is above a threshold."""
    names, rows = _gct(spark, path)
    found = [i for i, n in enumerate(names) if pattern in n]
    if not found:
        raise ValueError(f"no column like {pattern}")
    median = C.row_median(*[F.col("f")[i] for i in found])
    return rows.filter(median >= above if inclusive else median > above).select(F.col("f")[names.index("Description")].alias("gene")).distinct()


def edges(spark: SparkSession, path: str, min_score: int | None = None, partitions: int | None = None) -> DataFrame:
    """(src, dst, score) of a space-separated list, gzip'd or not, a file or a folder of files that each have the header.

    A gzip'd file can't be split, so rows of fewer files than the session's tasks are dealt anew; of more files each is a task's part.
    """
    df = spark.read.schema("src string, dst string, score int").option("header", True).option("sep", " ").csv(path)
    df = df if min_score is None else df.filter(F.col("score") >= min_score)
    tasks = partitions or spark.sparkContext.defaultParallelism
    few = path.endswith(".gz") and (partitions is not None or len(df.inputFiles()) < tasks)
    return df.repartition(tasks) if few else df


def names(spark: SparkSession, path: str, species_prefix: str | None = None) -> DataFrame:
    """(id, name) of a tab-separated list with two fields or more; with a prefix only its ids, without it."""
    df = spark.read.schema("id string, name string").option("header", True).option("sep", "\t").option("mode", "PERMISSIVE").csv(path).dropna()
    if species_prefix:
        df = df.filter(F.col("id").startswith(species_prefix)).withColumn("id", F.expr(f"substring(id, {len(species_prefix) + 1})"))
    return df


def severity_list(spark: SparkSession, path: str) -> DataFrame:
    """The severity list, exported from its workbook as CSV after one line of preamble, with ``category``."""
    lines = spark.read.text(path).withColumn("k", F.monotonically_increasing_id())
    body = lines.filter(~F.col("value").startswith("LTKBID")).orderBy("k").select("k", F.from_csv("value", SEVERITY.replace("`", "").replace("vDILI-Concern", "concern")).alias("r"))
    return body.filter("r.concern is not null").select("r.*").withColumn("category", F.trim(F.lower("concern")))


def cache(spark: SparkSession, path: str) -> DataFrame:
    """(name, smiles) of JSON objects, one a line, or of one object over many lines; a file that can't be read as either, or isn't there, gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "name string, smiles string")
    parsed = lambda rows: rows.filter(F.trim("value") != "").select(F.from_json("value", "map<string,string>").alias("m"))
    lines = parsed(spark.read.text(path))
    found = lines if lines.filter("m is null").isEmpty() else parsed(spark.read.text(path, wholetext=True))
    return found.select(F.explode("m").alias("name", "smiles"))


def graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a Parquet file whatever its endpoint columns are called."""
    return C.resolve_edges(spark.read.parquet(path))


def gene_set(spark: SparkSession, *paths: str) -> DataFrame:
    """(node): genes of the first CSV that is there."""
    return C.resolve_genes(spark.read.option("header", True).csv(first_existing(spark, *paths)))


def target_set(df: DataFrame, compound: str, gene: str = "gene_symbol") -> DataFrame:
    return df.filter(F.col("compound") == compound).select(F.col(gene).alias("node")).distinct().orderBy("node")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
