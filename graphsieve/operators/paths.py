"""Unweighted shortest paths and proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .graph import nodes_of, symmetric
from .iterate import checkpointed, placed


def distances(edges: DataFrame, sources: DataFrame, max_depth: int = 1000, nodes: DataFrame | None = None) -> DataFrame:
    """(node, dist) from the nearest source in the graph; unreachable nodes are left out.

    One search from all sources at once: edges are hash-partitioned by their start and kept, so a level shuffles only its
    frontier and its result.
    """
    edges = checkpointed(edges.select("src", "dst"))
    sym = symmetric(edges).filter("src <> dst")
    known = nodes_of(edges) if nodes is None else nodes.select("node").distinct()
    sym = sym.repartition("src").persist()
    seen = checkpointed(known.join(sources.select("node").distinct(), "node", "left_semi").withColumn("dist", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = sym.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(reached.join(seen, "node", "left_anti").withColumn("dist", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    sym.unpersist()
    return seen


#: Sources that share a search.
SOURCES = 512


def pair_distances(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 1000, nodes: DataFrame | None = None, at_once: int = SOURCES) -> DataFrame:
    """(target, source, dist) of every target that a source reaches, by searches of many sources at once (``tiles.reach``).

    Sources and targets that are no nodes are left out; a node is at distance 0 from itself; listed twice counts once.
    """
    edges = checkpointed(edges.select("src", "dst"))
    known = checkpointed(nodes_of(edges) if nodes is None else nodes.select("node").distinct())
    entries = checkpointed(symmetric(edges).filter("src <> dst").select(F.col("dst").alias("to"), F.col("src").alias("from"), F.lit(1.0).alias("w")))
    from_ = checkpointed(placed(known.join(sources.select("node").distinct(), "node", "left_semi"), "node", place="_number"))
    wanted = targets.select("node").distinct()
    numbers = tiles.numbered(known)
    out = None
    for first in range(0, from_.count(), at_once):
        named = from_.filter(F.col("_number").between(first, first + at_once - 1)).select("node", (F.col("_number") - first).cast("int").alias("col"))
        columns = named.count()
        t = tiles.tiled(entries, numbers, named.withColumn("b", F.lit(1.0)), columns)
        met = tiles.reach(t, columns, max_depth).join(numbers.join(wanted, "node", "left_semi"), "place")
        met = checkpointed(met.join(F.broadcast(named.withColumnRenamed("node", "source")), "col").select(F.col("node").alias("target"), "source", "dist"))
        t.release()
        out = met if out is None else out.unionAll(met)
    return out if out is not None else known.limit(0).select(F.col("node").alias("target"), F.col("node").alias("source"), F.lit(0).alias("dist"))


def proximity(dist: DataFrame, targets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., dc, n_reached): the mean distance of targets (node, by...) that are reached; a target listed twice counts twice.  dc is null if none is."""
    by = by or []
    return targets.join(dist, "node", "left").groupBy(*by).agg(F.avg("dist").alias("dc"), F.count("dist").alias("n_reached"))
