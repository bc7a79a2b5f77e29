"""The whole analysis from files to result tables, as steps of the runner."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import checks, diffusion, graph, paths, reshape, sampling, similarity, stats, tables
from ..operators.iterate import checkpointed
from ..sources import readers, sinks
from .runner import Step


@dataclass(frozen=True)
class Study:
    """Inputs, the output folder and parameters.  compounds: the small and the large target set."""

    links: str
    info: str
    expression: str
    targets: str
    mapping: str
    disease: str
    out: str
    disease_name: str
    compounds: tuple[str, str]
    fingerprints: str | None = None  # Parquet: name, category (null: a test compound), bits
    tissue: str = "Liver"
    thresholds: tuple[int, ...] = (700, 900)
    min_tpm: float = 1.0
    permutations: int = 1000
    iterations: int = 100
    seed: int = 42
    expected: dict[str, int] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str) -> None:
        sinks.parquet(df, self.path(name))


def networks(s: Study, spark: SparkSession) -> None:
    """Canonical, mapped edges at every threshold."""
    links, names = readers.edges(spark, s.links, min(s.thresholds)), readers.names(spark, s.info)
    for t in s.thresholds:
        s.write(graph.extract(links, names, t), f"network_{t}")


def targets(s: Study, spark: SparkSession) -> None:
    """Curated targets: mapped, of the species, each compound and accession once, in file order."""
    raw = readers.csv(spark, s.targets, readers.TARGETS).withColumn("ord", F.monotonically_increasing_id())
    s.write(tables.curate(raw, readers.mapping(spark, s.mapping), [F.col("ord")]), "targets")


def tissue(s: Study, spark: SparkSession) -> None:
    """Expressed genes, the networks' largest components among them, and the targets in all of those."""
    x = readers.expression(spark, s.expression, s.tissue, s.min_tpm)
    s.write(x.orderBy(F.desc("tpm"), "gene"), "tissue")
    keep = s.read(spark, "tissue").select(F.col("gene").alias("node"))
    flags = {}
    for t in s.thresholds:
        e = s.read(spark, f"network_{t}")
        lcc = checkpointed(graph.filter_to(e, graph.nodes_of(e), keep))
        s.write(graph.induced(e, lcc), f"network_{t}_lcc")
        flags[f"in_lcc_{t}"] = lcc
    named = s.read(spark, "targets").select(F.col("gene_name").alias("node"), "compound").distinct()
    flagged = tables.with_flags(named, "node", **flags).join(s.read(spark, "tissue").withColumnRenamed("gene", "node"), "node")
    inside = reduce(lambda a, b: a & b, [F.col(c) for c in flags])
    s.write(flagged.filter(inside).select(F.col("node").alias("gene_symbol"), "compound", F.col("tpm").alias("liver_tpm"), *flags), "targets_lcc")


def disease(s: Study, spark: SparkSession) -> None:
    """The disease's genes, of repeated ones the first, and those in each network's component."""
    raw = readers.csv(spark, s.disease, "geneSymbol string, geneId long, score double, diseaseName string, diseaseId string", "\t").withColumn("ord", F.monotonically_increasing_id())
    one = tables.keep_first(raw.filter(F.col("diseaseName") == s.disease_name).withColumnRenamed("geneSymbol", "gene_name"), ["gene_name"], [F.col("ord")]).drop("ord")
    s.write(one.orderBy(F.desc("score"), "gene_name"), "disease")
    for t in s.thresholds:
        lcc = graph.nodes_of(s.read(spark, f"network_{t}_lcc")).withColumnRenamed("node", "gene_name")
        s.write(s.read(spark, "disease").join(lcc, "gene_name", "left_semi").withColumn("protein_id", F.col("gene_name")), f"disease_{t}_lcc")


def report(s: Study, spark: SparkSession) -> DataFrame:
    """Integrity checks: components are connected and free of loops, sets lie in their networks, counts are as expected (warnings)."""
    n = lambda df: df.agg(F.count("*").alias("n"))
    out = []
    goal = s.read(spark, "targets_lcc").select(F.col("gene_symbol").alias("node"))
    for t in s.thresholds:
        e = s.read(spark, f"network_{t}_lcc")
        nodes = graph.nodes_of(e)
        ill = s.read(spark, f"disease_{t}_lcc").select(F.col("gene_name").alias("node"))
        out += [
            checks.Check(f"network_{t} connected", graph.validate(e).select("connected"), True),
            checks.Check(f"network_{t} loops", n(e.filter("src = dst")), 0),
            checks.Check(f"network_{t} targets outside", n(tables.only_in(goal, nodes)), 0),
            checks.Check(f"network_{t} disease genes outside", n(tables.only_in(ill, nodes)), 0),
        ]
    for low, high in zip(s.thresholds, s.thresholds[1:], strict=False):
        inside = tables.is_subset(graph.nodes_of(s.read(spark, f"network_{high}_lcc")), graph.nodes_of(s.read(spark, f"network_{low}_lcc")))
        out.append(checks.Check(f"component {high} in {low}", inside.select("subset"), True, "warning"))
    out += [checks.Check(f"rows of {name}", n(s.read(spark, name)), k, "warning") for name, k in s.expected.items()]
    return checks.run(out)


def validate(s: Study, spark: SparkSession) -> None:
    found = checkpointed(report(s, spark))
    s.write(found, "checks")
    if checks.failed(found):
        raise ValueError("; ".join(r["check"] for r in found.filter("not ok and severity = 'error'").collect()))


def _sets(s: Study, spark: SparkSession) -> DataFrame:
    return s.read(spark, "targets_lcc").select("compound", F.col("gene_symbol").alias("node")).distinct()


def _ill(s: Study, spark: SparkSession, t: int) -> DataFrame:
    return s.read(spark, f"disease_{t}_lcc").select(F.col("gene_name").alias("node"))


def _influence(s: Study, spark: SparkSession, t: int, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """The network's edges and each node's influence on the disease."""
    e = s.read(spark, f"network_{t}_lcc")
    x = s.read(spark, "tissue").select(F.col("gene").alias("node"), F.col("tpm").alias("x"))
    w = diffusion.normalise(graph.nodes_of(e), x) if weighted else None
    return e, checkpointed(diffusion.adjoint(e, _ill(s, spark, t), weight=w))


def _null(s: Study, e: DataFrame, sets: DataFrame, mode: str, value) -> DataFrame:
    """(compound, value): value of each permutation's draws (perm_id, node)."""
    deg = checkpointed(graph.degree(e))
    per = [value(sampling.drawn_in_turn(deg, sets.filter(F.col("compound") == c), s.permutations, s.seed, mode)).select(F.lit(c).alias("compound"), "value") for c in s.compounds]
    return reduce(DataFrame.unionAll, per)


def permutation(s: Study, spark: SparkSession, weighted: bool, name: str) -> None:
    """Influence against degree-matched sets; q-values within a threshold."""
    rows = []
    sets = _sets(s, spark)
    tpm = sets.join(s.read(spark, "tissue").withColumnRenamed("gene", "node"), "node", "left").groupBy("compound").agg(F.avg(F.coalesce("tpm", F.lit(0.0))).alias("mean_target_tpm"))
    for t in s.thresholds:
        e, h = _influence(s, spark, t, weighted)
        observed = diffusion.influence(h, sets, ["compound"])
        null = _null(s, e, sets, "M1", lambda draws, h=h: draws.join(h, "node").groupBy("perm_id").agg(F.avg("h").alias("value")))
        out = stats.null_summary(null, observed.select("compound", F.col("influence").alias("observed")), ["compound"]).join(observed.select("compound", "n_targets"), "compound")
        rows.append(out.withColumn("network_threshold", F.lit(t)))
    scored = stats.bh(reduce(DataFrame.unionAll, rows), ["network_threshold"]).withColumn("significant", F.col("p_fdr") < 0.05)
    scored = scored.join(tpm, "compound") if weighted else scored
    s.write(scored.withColumnRenamed("observed", "observed_influence"), name)


def path_permutation(s: Study, spark: SparkSession) -> None:
    """Mean distance against degree-matched sets; q-values over all rows, significance by the raw p."""
    rows = []
    sets = _sets(s, spark)
    for t in s.thresholds:
        e = s.read(spark, f"network_{t}_lcc")
        dist = checkpointed(paths.distances(e, _ill(s, spark, t)))
        observed = paths.proximity(dist, sets, ["compound"]).select("compound", F.col("dc").alias("observed"))
        null = _null(s, e, sets, "M2", lambda draws, dist=dist: paths.proximity(dist, draws, ["perm_id"]).select(F.col("dc").alias("value")).filter("value is not null"))
        out = stats.null_summary(null, observed, ["compound"], "one_less").join(sets.groupBy("compound").agg(F.count("*").alias("n_targets")), "compound")
        rows.append(out.withColumn("network_threshold", F.lit(t)))
    scored = stats.bh(reduce(DataFrame.unionAll, rows), [])
    s.write(scored.withColumn("significant", F.col("p_value") < 0.05).withColumnRenamed("observed", "observed_dc"), "path_permutation")


def bootstrap(s: Study, spark: SparkSession, weighted: bool, name: str) -> None:
    """The small set's influence against subsets of the large one of its size, in the strictest network."""
    _, h = _influence(s, spark, s.thresholds[-1], weighted)
    sets = _sets(s, spark)
    small, large = (sets.filter(F.col("compound") == c).select("node") for c in s.compounds)
    observed = diffusion.influence(h, sets.filter(F.col("compound") == s.compounds[0]), ["compound"]).select(F.col("influence").alias("o"))
    values = sampling.bootstrap(large, small.count(), s.iterations, s.seed).join(h, "node").groupBy("iter").agg(F.avg("h").alias("value"))
    s.write(values, f"{name}_values")
    out = stats.bootstrap_summary(s.read(spark, f"{name}_values").crossJoin(F.broadcast(observed)), F.col("o"), [])
    s.write(out.withColumns({"ratio": C.ratio(F.col("observed"), F.col("mean")), "conclusion": C.verdict(F.col("observed"), F.col("ci_lower"), F.col("ci_upper"))}), name)


def chemistry(s: Study, spark: SparkSession) -> None:
    """Similarity of the test compounds to the references of either class; without fingerprints there is nothing to do."""
    if s.fingerprints is None:
        return
    f = spark.read.parquet(s.fingerprints)
    tests = f.filter("category is null").select(F.col("name").alias("compound"), "bits")
    refs = f.select(F.col("name").alias("reference"), C.severity(F.col("category")).alias("category"), "bits").filter("category is not null")
    pairs = similarity.pairs(tests, refs)
    s.write(pairs, "similarity_pairs")
    s.write(similarity.summary(s.read(spark, "similarity_pairs")), "similarity")


def consolidated(s: Study, spark: SparkSession) -> DataFrame:
    """(compound, metric, network_threshold, n_targets, observed, z_score, p_value, efficiency, significant) of all metrics."""
    out = []
    for metric, name, col in (("RWR", "permutation", "observed_influence"), ("EWI", "weighted_permutation", "observed_influence"), ("d_c", "path_permutation", "observed_dc")):
        d = s.read(spark, name)
        efficiency = F.col(col) if col == "observed_influence" else F.lit(None).cast("double")
        out.append(d.select("compound", F.lit(metric).alias("metric"), "network_threshold", "n_targets", F.col(col).alias("observed"), "z_score", "p_value", efficiency.alias("efficiency"), "significant"))
    return readers.union(out)


def document(s: Study, spark: SparkSession) -> None:
    """The consolidated table and a traceability report."""
    s.write(consolidated(s, spark), "consolidated")
    raw = readers.csv(spark, s.targets, readers.TARGETS).withColumn("ord", F.monotonically_increasing_id())
    m = readers.mapping(spark, s.mapping)
    gaps = reshape.wide(s.read(spark, "consolidated").filter(F.col("network_threshold") == s.thresholds[-1]), "metric", "compound", list(s.compounds), "z_score")
    text = sinks.markdown("Data flow", {
        "Curation": tables.curation_audit(raw, m).orderBy("compound"), "Raw targets": tables.exclusion_trace(raw, m, "ord").orderBy("compound", "idx"),
        "Targets in the network": s.read(spark, "targets_lcc").orderBy("compound", "gene_symbol"), "z-scores": gaps.orderBy("metric"), "Checks": s.read(spark, "checks"),
    })
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(s.path("data_flow"))


def steps(s: Study) -> list[Step]:
    """All steps; components come before the disease genes, which need them."""
    out = lambda *names: [s.path(n) for n in names]
    nets, lccs = [f"network_{t}" for t in s.thresholds], [f"network_{t}_lcc" for t in s.thresholds]
    listed = [
        ("networks", networks, out(*nets), True, False), ("targets", targets, out("targets"), False, False), ("tissue components", tissue, out("tissue", "targets_lcc", *lccs), False, False),
        ("disease genes", disease, out("disease"), False, False), ("validate", validate, out("checks"), False, True),
        ("permutation", partial(permutation, weighted=False, name="permutation"), out("permutation"), False, False),
        ("weighted permutation", partial(permutation, weighted=True, name="weighted_permutation"), out("weighted_permutation"), False, False),
        ("path permutation", path_permutation, out("path_permutation"), False, False),
        ("bootstrap", partial(bootstrap, weighted=False, name="bootstrap"), out("bootstrap"), False, False), ("weighted bootstrap", partial(bootstrap, weighted=True, name="weighted_bootstrap"), out("weighted_bootstrap"), False, False),
        ("similarity", chemistry, out("similarity") if s.fingerprints else [], False, False), ("document", document, out("consolidated", "data_flow"), False, False),
    ]
    return [Step(k, name, partial(f, s), outputs, skip, required) for k, (name, f, outputs, skip, required) in enumerate(listed, 1)]
