"""Named queries that write files from the star-schema tables and read them by the scans, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.iterate import shared_folder
from ..sources import readers, sinks
from . import cli, runner
from . import derived as D
from . import sql as S
from .catalog import query


def _folder(spark: SparkSession) -> str:
    """A folder for the files of one call, in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _text(spark: SparkSession, head: list[str], body: DataFrame, path: str, **options: str) -> str:
    """A text file: the head's lines, then those of body (k, line) in order of k."""
    first = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "k long, line string")
    first.unionAll(body.select(F.col("k").cast("long"), "line")).orderBy("k").select("line").coalesce(1).write.options(**options).text(path)
    return path


def _join(*parts: Column | str, by: str) -> Column:
    return F.concat_ws(by, *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "part").withColumn("k", F.col("p_partkey"))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part")
def source_csv(spark, sf):
    path = _folder(spark)
    sinks.csv(D.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), path)
    return readers.csv(spark, path, "p_partkey long, p_brand string, p_retailprice double")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_tsv(spark, sf):
    path = _folder(spark)
    D.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("sep", "\t").option("header", True).csv(path)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_acctbal double", "\t")


@query("SELECT 'P' || p_partkey % 400 AS protein_id, arg_max(CASE p_partkey % 5 WHEN 0 THEN 'ABCB1' ELSE 'G' || p_size END, p_partkey) AS gene_name FROM part WHERE p_partkey % 5 IN (0, 1, 4) GROUP BY 1")
def source_mapping(spark, sf):
    """Comments, lines without and with too many fields, repeated ids, an alias."""
    id_, k = F.concat(F.lit("P"), F.col("p_partkey") % 400), F.col("p_partkey") % 5
    line = F.when(k == 0, _join(id_, "MDR1", by=",")).when(k == 2, "a line").when(k == 3, _join(id_, "a", "b", by=",")).otherwise(_join(id_, F.concat(F.lit("G"), "p_size"), by=","))
    return readers.mapping(spark, _text(spark, ["# ids", "# P0,none", ""], _part(spark, sf).select("k", line.alias("line")), _folder(spark)))


def _matrix(spark, sf) -> str:
    symbol = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("G"), F.col("p_partkey") % 300))
    liver = F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("p_retailprice").cast("string"))
    line = _join(F.concat(F.lit("E"), "p_partkey"), symbol, liver, F.col("p_size").cast("string"), "1", by="\t")
    return _text(spark, ["#1.2", "1\t3", "Name\tDescription\tLiver\tLiver - left\tLung"], _part(spark, sf).select("k", line.alias("line")), _folder(spark))


@query("SELECT 'G' || p_partkey % 300 AS gene, arg_max(p_retailprice, p_partkey) AS tpm FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0 GROUP BY 1")
def source_expression(spark, sf):
    return readers.expression(spark, _matrix(spark, sf))


@query("SELECT 'G' || p_partkey % 300 AS gene, arg_max(p_retailprice, p_partkey) AS tpm FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0 AND p_retailprice >= 950 GROUP BY 1")
def source_expression_map(spark, sf):
    """The last row of those that pass the threshold."""
    return readers.expression(spark, _matrix(spark, sf), at_least=950.0)


@query("SELECT DISTINCT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'G' || p_partkey % 300 END AS gene FROM part WHERE CASE WHEN p_partkey % 7 = 0 THEN p_size ELSE (p_retailprice + p_size) / 2 END > 480")
def source_expressed_set(spark, sf):
    """Symbols by the median over the tissue's columns."""
    return readers.expressed(spark, _matrix(spark, sf), above=480.0)


def _links(spark, sf, times: int) -> str:
    """A folder of gzip'd files, each with the header, as no task should group or write all links."""
    path = f"{_folder(spark)}.txt.gz"
    rows = D.links(spark, sf).select(F.col("src").alias("protein1"), F.col("dst").alias("protein2"), (F.col("score") * times).alias("combined_score"))
    rows.write.option("sep", " ").option("header", True).option("compression", "gzip").csv(path)
    return path


@query(S.with_("SELECT src, dst, CAST(score * 100 AS INTEGER) AS score FROM links WHERE score >= 2"))
def source_edges_gzip(spark, sf):
    return readers.edges(spark, _links(spark, sf, 100), 200)


def _names(spark, sf) -> str:
    k = F.col("s_suppkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("9606.s"), k)).otherwise(_join(F.concat(F.when(k % 3 == 0, "10090.s").otherwise("9606.s"), k), F.concat(F.lit("N"), k), "x", by="\t"))
    return _text(spark, ["#string_protein_id\tpreferred_name\tsize"], D.table(spark, sf, "supplier").select(k.alias("k"), line.alias("line")), _folder(spark), compression="gzip")


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN '10090.s' ELSE '9606.s' END || s_suppkey AS id, 'N' || s_suppkey AS name FROM supplier WHERE s_suppkey % 5 > 0")
def source_names(spark, sf):
    return readers.names(spark, _names(spark, sf))


@query("SELECT 's' || s_suppkey AS id, 'N' || s_suppkey AS name FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 3 > 0")
def source_names_of_species(spark, sf):
    return readers.names(spark, _names(spark, sf), "9606.")


_SEVERITY = "SELECT 'L' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'vmost-dili-concern' WHEN 1 THEN 'vno-dili-concern' ELSE 'ambiguous dili-concern' END AS category FROM part"


def _severity(spark, sf) -> DataFrame:
    kind = F.element_at(F.array(F.lit(" vMost-DILI-Concern "), F.lit("vNo-DILI-concern"), F.lit("Ambiguous DILI-concern")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _part(spark, sf).select("k", F.array(F.concat(F.lit("L"), "p_partkey"), F.col("p_name"), F.lit("8"), F.lit("Box"), kind, F.lit("")).alias("cells"))


@query(_SEVERITY)
def source_severity_csv(spark, sf):
    path = _text(spark, ["a title", "LTKBID,CompoundName,SeverityClass,LabelSection,vDILI-Concern,Comment"], _severity(spark, sf).select("k", F.array_join("cells", ",").alias("line")), _folder(spark))
    return readers.severity_list(spark, path).select(F.col("LTKBID").alias("id"), "category")


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS smiles FROM part")
def source_cache(spark, sf):
    """A JSON object written and read; a missing value stays as a known miss."""
    path = _folder(spark)
    sinks.cache(_part(spark, sf).select(F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("smiles")), path)
    return readers.cache(spark, path)


@query("SELECT 'region' AS file, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def source_many(spark, sf):
    """Several files that must all be there."""
    root, schemas = _folder(spark), {"region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int"}
    for name in schemas:
        sinks.csv(D.table(spark, sf, name), f"{root}/{name}")
    read = readers.many(spark, {f"{root}/{name}": schema for name, schema in schemas.items()})
    return readers.union([read[f"{root}/{name}"].agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "n") for name in schemas])


@query("SELECT DISTINCT p_brand AS node FROM part")
def source_gene_set(spark, sf):
    """The gene column of the file that stands in for one that isn't there."""
    root = _folder(spark)
    sinks.csv(D.table(spark, sf, "part").select("p_size", F.col("p_brand").alias("gene_symbol")), f"{root}/all")
    return readers.gene_set(spark, f"{root}/none", f"{root}/all")


@query(S.with_("SELECT src, dst, score FROM e"))
def source_graph(spark, sf):
    """Parquet edges under other endpoint names (also the Parquet sink)."""
    path = _folder(spark)
    sinks.parquet(graph.canonical(D.links(spark, sf).filter(F.col("score") >= D.LOOSE)).withColumnsRenamed({"src": "gene1", "dst": "gene2"}), path, 4)
    return readers.graph(spark, path)


@query("SELECT r_name AS file, r_regionkey % 2 = 0 AS pointer FROM region")
def source_pointer(spark, sf):
    """Large-file pointers told from files of content, a file a region."""
    root, found = _folder(spark), []
    regions = D.table(spark, sf, "region").select("r_regionkey", "r_name")
    for r in regions.collect():  # a file each, as the scan under test takes one path
        path, row = f"{root}/{r['r_regionkey']}", regions.filter(F.col("r_regionkey") == r["r_regionkey"])
        line = F.concat(F.lit(f"{readers.POINTER}/v1\noid sha256:"), F.sha2("r_name", 256), F.lit("\nsize "), F.length("r_name"))
        row.select((line if r["r_regionkey"] % 2 == 0 else F.col("r_name")).alias("line")).coalesce(1).write.text(path)
        found.append((r["r_name"], readers.is_pointer(spark, path)))
    return readers.literal(spark, found, "file string, pointer boolean")


@query(S.with_("SELECT DISTINCT node FROM targets WHERE compound = 'A'"))
def source_target_set(spark, sf):
    path = _folder(spark)
    sinks.csv(D.targets(spark, sf).withColumnRenamed("node", "gene_symbol"), path)
    return readers.target_set(readers.csv(spark, path, "compound string, gene_symbol string"), "A")


@query("""SELECT 0 AS k, '# Regions' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '## All' UNION ALL SELECT 3, '' UNION ALL SELECT 4, '| r_regionkey | r_name |' UNION ALL SELECT 5, '|---|---|'
  UNION ALL SELECT 5 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region UNION ALL SELECT 6 + (SELECT count(*) FROM region), ''""")
def sink_markdown(spark, sf):
    text = sinks.markdown("Regions", {"All": D.table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")})
    return readers.literal(spark, [(text,)], "t string").select(F.posexplode(F.split("t", "\n", -1)).alias("k", "line")).withColumn("k", F.col("k").cast("long"))


@query("""SELECT CAST(2 * r_regionkey + 1 AS INTEGER) AS number, r_name AS name, CASE WHEN n % 2 = 1 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n % 2 = 0 THEN n END AS n_rows FROM (SELECT r_regionkey, r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2)
  UNION ALL SELECT CAST(2 * r_regionkey + 2 AS INTEGER), 'again ' || r_name, CASE WHEN n % 2 = 1 THEN 'failed' ELSE 'skipped' END, CASE WHEN n % 2 = 0 THEN n END FROM (SELECT r_regionkey, r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2)""")
def step_outcomes(spark, sf):
    """Two steps a region: its nations are written unless they are odd in number, then written again unless they are there; the rows that each step's output holds."""
    root, nations = _folder(spark), D.table(spark, sf, "nation")
    regions = D.table(spark, sf, "region").select("r_regionkey", "r_name").collect()

    def step(key: int):
        def write(s: SparkSession) -> None:
            mine = nations.filter(F.col("n_regionkey") == key)
            if mine.count() % 2:
                raise ValueError("an odd number")
            sinks.parquet(mine, f"{root}/{key}")

        return write

    steps = []
    for r in regions:
        key, name, out = r["r_regionkey"], r["r_name"], [f"{root}/{r['r_regionkey']}"]
        steps += [runner.Step(2 * key + 1, name, step(key), out), runner.Step(2 * key + 2, f"again {name}", step(key), out, skip_if_exists=True)]
    done = runner.run(spark, steps)
    rows = [(o.number, o.name, o.status, readers.parquet(spark, f"{root}/{(o.number - 1) // 2}").count() if o.status != "failed" else None) for o in done]
    return readers.literal(spark, rows, "number int, name string, status string, n_rows long")


@query(S.with_("SELECT upper(src) AS src, upper(dst) AS dst, CAST(score * 350 AS INTEGER) AS score FROM e"))
def cli_extract(spark, sf):
    """The command line's extraction, from files to an edge table."""
    out = _folder(spark)
    nodes = graph.nodes_of(D.links(spark, sf))
    info = _folder(spark)
    nodes.select(F.col("node").alias("#string_protein_id"), F.upper("node").alias("preferred_name"), F.lit(1).alias("size")).write.option("sep", "\t").option("header", True).csv(info)
    if cli.main(["extract", "--links", _links(spark, sf, 350), "--info", info, "--threshold", "700", "--output", out], spark):
        raise RuntimeError("the extraction failed")
    return readers.parquet(spark, out)
