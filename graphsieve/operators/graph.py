"""Undirected simple graphs as edge and node tables: building, restricting, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import checkpointed


def canonical(edges: DataFrame, min_score: float | None = None, drop_loops: bool = True) -> DataFrame:
    """(src, dst[, score]) with src <= dst, each pair once with its best score."""
    scored = "score" in edges.columns
    if scored and min_score is not None:
        edges = edges.filter(F.col("score") >= min_score)
    if drop_loops:
        edges = edges.filter("src <> dst")
    pair = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *(["score"] if scored else []))
    return pair.groupBy("src", "dst").agg(F.max("score").alias("score")) if scored else pair.distinct()


def map_endpoints(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends renamed by mapping (id, name); an edge with an unmapped end goes."""
    m = mapping.dropna().dropDuplicates(["id"])
    a, b = m.select(F.col("id").alias("src"), F.col("name").alias("_a")), m.select(F.col("id").alias("dst"), F.col("name").alias("_b"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"), *rest)


def extract(links: DataFrame, mapping: DataFrame, min_score: float) -> DataFrame:
    """Thresholded, mapped, loop-free, canonical edges; the threshold goes before the joins."""
    return canonical(map_endpoints(links.filter(F.col("score") >= min_score), mapping))


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, each once; a loop once."""
    e = edges.select("src", "dst")
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree); a loop counts twice; nodes given without an edge have 0."""
    ends = canonical(edges.select("src", "dst"), drop_loops=False).select(F.explode(F.array("src", "dst")).alias("node"))
    deg = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return deg if nodes is None else nodes.select("node").distinct().join(deg, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def counts(edges: DataFrame) -> DataFrame:
    """One row (n_nodes, n_edges)."""
    e = canonical(edges.select("src", "dst"), drop_loops=False)
    return e.agg(F.count("*").alias("n_edges")).crossJoin(nodes_of(e).agg(F.count("*").alias("n_nodes"))).select("n_nodes", "n_edges")


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep (node)."""
    k = keep.select("node").distinct()
    return edges.join(k.withColumnRenamed("node", "src"), "src", "left_semi").join(k.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, comp): the smallest node of its component; nodes without an edge are their own.

    By alternating large and small stars; a round's table is checkpointed, so plans stay short, and O(log n) rounds suffice.
    """
    edges = checkpointed(edges.select("src", "dst"))
    e = checkpointed(canonical(edges.select("src", "dst")).select(F.col("dst").alias("u"), F.col("src").alias("v")))
    last = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both_ways = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = checkpointed(large.join(low, "u").select(F.explode(both_ways).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    every = (nodes_of(edges) if nodes is None else nodes.select("node").distinct()).select("node", F.col("node").alias("comp"))
    return labels.unionAll(every).groupBy("node").agg(F.min("comp").alias("comp"))


def largest_component(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node) of the largest component, of equals the one with the smallest label; an empty graph gives none."""
    comp = checkpointed(components(edges, nodes))
    top = comp.groupBy("comp").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "comp").limit(1)
    return comp.join(F.broadcast(top.select("comp")), "comp", "left_semi").select("node")


def network(links: DataFrame, mapping: DataFrame, min_score: float) -> DataFrame:
    """(src, dst, score): the mapped, thresholded graph (extract) cut to its largest component; no edge gives no rows."""
    e = checkpointed(extract(links, mapping, min_score))
    return induced(e, largest_component(e))


def filter_to(edges: DataFrame, nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """(node) of the largest component of the subgraph that keep induces; isolated kept nodes count."""
    inside = nodes.join(keep.select("node").distinct(), "node", "left_semi")
    return largest_component(induced(edges, inside), inside)


def validate(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row (n_nodes, n_components, connected); an empty graph raises ValueError."""
    out = components(edges, nodes).agg(F.count("*").alias("n_nodes"), F.count_distinct("comp").alias("n_components")).withColumn("connected", F.col("n_components") == 1)
    out = checkpointed(out)
    if out.first()["n_nodes"] == 0:
        raise ValueError("the graph is empty")
    return out


def direct_neighbours(edges: DataFrame, targets: DataFrame, disease: DataFrame) -> DataFrame:
    """(node, n_neighbours, n_disease, share) of every target in the graph."""
    near = symmetric(edges).filter("src <> dst").join(targets.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    hit = near.join(disease.select(F.col("node").alias("dst")).distinct().withColumn("hit", F.lit(1)), "dst", "left")
    return hit.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_neighbours"), F.count("hit").alias("n_disease")).withColumn("share", F.col("n_disease") / F.col("n_neighbours"))
