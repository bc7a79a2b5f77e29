"""Connected components of a link table by alternating stars, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work

def components(links: DataFrame, work: Work, tag: str) -> DataFrame:
    """(v, comp) for every v of the links (a, b): comp is the smallest vertex reachable.

    A large star ties each vertex's larger neighbours to its smallest one, a small star its smaller
    ones; after O(log n) rounds each component is one star.  Every round is a staged table, so lineage
    stays short.  A self-link gives a component of one; no links give no rows.
    """
    edges = work.stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}0")
    loops = edges.filter("u = v").select(F.col("u").alias("v"), F.col("u").alias("comp"))
    edges, last, k = edges.filter("u <> v"), None, 0
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        starred = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        k += 1
        edges = work.stage(starred, f"{tag}{k}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if k > 1:
            work.drop(f"{tag}{k - 1}")
        if now == last or now[0] == 0:
            break
        last = now
    labels = edges.select(F.col("u").alias("v"), F.col("v").alias("comp"))
    return labels.unionAll(labels.select(F.col("comp").alias("v"), "comp")).unionAll(loops).groupBy("v").agg(F.min("comp").alias("comp"))
