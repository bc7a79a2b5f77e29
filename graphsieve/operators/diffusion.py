"""Random walk with restart, plain and weighted by node expression, forward and adjoint.

Forward: p <- (1 - a) W p + a r from p = r.  A functional of the result, sum p over a set D, is linear in r,
so with h <- (1 - a) W^T h + a 1_D from h = 1_D the influence of any seed set is the mean of h over it:
one loop for a network serves every permutation and bootstrap as a join and an average.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .graph import nodes_of, symmetric
from .iterate import checkpointed, placed

ALPHA, TOL, MAX_ITER = 0.15, 1e-6, 100
#: Seed sets that share a loop.
COLUMNS = 128


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", *(["weight"] if "weight" in edges.columns else []))


def transition(edges: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """(src, dst, w): column-stochastic weights of going from src to dst.

    Plain: 1 / degree(src).  With weight (node, e): e(dst) over the sum of e of src's neighbours (destination
    weighting).  A column ``weight`` of the edges multiplies each edge's share; of an edge listed twice the
    greater weight holds.  A sum of 0 counts as 1.
    """
    if "weight" in edges.columns:
        both = edges.select("src", "dst", "weight").unionAll(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        sym = both.groupBy("src", "dst").agg(F.max("weight").cast("double").alias("a"))
    else:
        sym = symmetric(edges).withColumn("a", F.lit(1.0))
    e = sym.withColumn("e", F.col("a")) if weight is None else sym.join(weight.select(F.col("node").alias("dst"), F.col("e").alias("x")), "dst").withColumn("e", F.col("a") * F.col("x"))
    total = F.sum("e").over(Window.partitionBy("src"))
    return e.select("src", "dst", (F.col("e") / F.when(total == 0, 1.0).otherwise(total)).alias("w"))


def normalise(nodes: DataFrame, expression: DataFrame, method: str = "log_minmax", floor: float = 0.01) -> DataFrame:
    """(node, e) in floor..1 by min-max over the nodes; missing expression (node, x) is 0; all equal gives 1."""
    if method not in ("minmax", "log_minmax"):
        raise ValueError(f"unknown method {method}")
    x = nodes.select("node").distinct().join(expression.select("node", "x"), "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("x"))
    if method == "log_minmax":
        x = x.withColumn("x", F.log2(F.col("x") + 1))
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scaled: Column = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return x.crossJoin(F.broadcast(span)).select("node", F.greatest(scaled, F.lit(floor)).alias("e"))


def restart(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, r): uniform over the seeds listed that are nodes; a seed listed twice widens the divisor only."""
    listed = seeds.join(nodes, "node", "left_semi")
    n = listed.agg(F.count("*").alias("n"))
    hit = listed.distinct().withColumn("hit", F.lit(1.0))
    return nodes.join(hit, "node", "left").crossJoin(F.broadcast(n)).select("node", F.when(F.col("hit").isNotNull(), 1.0 / F.col("n")).otherwise(0.0).alias("r"))


def _walked(entries: DataFrame, nodes: DataFrame, start: DataFrame, alpha: float, steps: int | None, tol: float, max_iter: int) -> DataFrame:
    """(node, p): the walk of one column from start (node, col, b) over all nodes, checkpointed."""
    numbers = tiles.numbered(nodes)
    t = tiles.tiled(entries, numbers, start, 1)
    out = checkpointed(tiles.walk(t, 1, alpha, steps, tol, max_iter).join(numbers, "place").select("node", "p"))
    t.release()
    return out


def rwr(edges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, steps: int | None = None, tol: float = TOL, max_iter: int = MAX_ITER, weight: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, p).  steps fixed, or until a step's L1 change is under tol, max_iter at most.

    An empty graph gives no rows, no seed in it all zeros.  A column ``weight`` of the edges counts (transition).
    The walk goes over tiles of the transition matrix (``tiles.walk``), whatever the graph's size.
    """
    edges = checkpointed(_ends(edges))
    nodes = checkpointed(nodes_of(edges) if nodes is None else nodes.select("node").distinct())
    w = transition(edges, weight).select(F.col("dst").alias("to"), F.col("src").alias("from"), "w")
    start = restart(nodes, seeds).select("node", F.lit(0).alias("col"), F.col("r").alias("b"))
    return _walked(w, nodes, start, alpha, steps, tol, max_iter)


def rwr_many(edges: DataFrame, sets: DataFrame, by: str, alpha: float = ALPHA, steps: int | None = None, tol: float = TOL, max_iter: int = MAX_ITER, weight: DataFrame | None = None, nodes: DataFrame | None = None, columns: int = COLUMNS) -> DataFrame:
    """(by, node, p): rwr from every seed set of sets (by, node), of which ``columns`` at a time are the columns of one loop over tiles (``tiles.walk``).

    Each set stops at its own step.  Sets without a seed in the graph give zeros; a null set is left out; the matrix is
    built once for each loop.
    """
    edges = checkpointed(_ends(edges))
    nodes = checkpointed(nodes_of(edges) if nodes is None else nodes.select("node").distinct())
    listed = sets.filter(F.col(by).isNotNull()).select(F.col(by).alias("_set"), "node")
    numbers = checkpointed(placed(listed.select("_set").distinct(), "_set", place="_number"))
    here = listed.join(nodes, "node", "left_semi")
    share = here.groupBy("_set").agg((1.0 / F.count("*")).alias("b"))
    start = checkpointed(here.distinct().join(share, "_set").join(numbers, "_set").select("node", "_number", "b"))
    w = checkpointed(transition(edges, weight).select(F.col("dst").alias("to"), F.col("src").alias("from"), "w"))
    places, out = tiles.numbered(nodes), None
    for first in range(0, numbers.count(), columns):
        named = numbers.filter(F.col("_number").between(first, first + columns - 1)).select("_set", (F.col("_number") - first).cast("int").alias("col"))
        some = start.filter(F.col("_number").between(first, first + columns - 1)).select("node", (F.col("_number") - first).cast("int").alias("col"), "b")
        columns_here = named.count()
        t = tiles.tiled(w, places, some, columns_here)
        walked = tiles.walk(t, columns_here, alpha, steps, tol, max_iter).join(places, "place").join(F.broadcast(named), "col")
        walked = checkpointed(walked.select(F.col("_set").alias(by), "node", "p"))
        t.release()
        out = walked if out is None else out.unionAll(walked)
    return out if out is not None else listed.limit(0).select(F.col("_set").alias(by), "node", F.lit(0.0).alias("p"))


def adjoint(edges: DataFrame, disease: DataFrame, alpha: float = ALPHA, steps: int | None = None, weight: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, h): the influence of a walk from node alone on the disease set, over tiles of the transposed matrix.

    Without steps, as many as bound any walk's change by TOL.
    """
    steps = math.ceil(math.log(TOL / 2) / math.log(1 - alpha)) if steps is None else steps
    edges = checkpointed(_ends(edges))
    nodes = checkpointed(nodes_of(edges) if nodes is None else nodes.select("node").distinct())
    start = nodes.join(disease.select("node").distinct(), "node", "left_semi").select("node", F.lit(0).alias("col"), F.lit(1.0).alias("b"))
    w = transition(edges, weight).select(F.col("src").alias("to"), F.col("dst").alias("from"), "w")
    return _walked(w, nodes, start, alpha, steps, TOL, steps).withColumnRenamed("p", "h")


def influence(h: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_targets, influence) of sets (by..., node), over members that are nodes."""
    return sets.select(*by, "node").distinct().join(h, "node").groupBy(*by).agg(F.count("*").alias("n_targets"), F.avg("h").alias("influence"))


def influence_of(p: DataFrame, disease: DataFrame) -> DataFrame:
    """One row (influence): the sum of p over the disease set, 0 if none is there."""
    return p.join(disease.select("node").distinct(), "node", "left_semi").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("influence"))
