"""Result reshaping for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide(df: DataFrame, key: str, column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(key).pivot(column, values).agg(F.first(value))


def long(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def waterfall(df: DataFrame) -> DataFrame:
    """Steps from the plain to the weighted gap: df has one row (a_plain, b_plain, a_weighted, b_weighted) of z-scores."""
    gap, da = F.col("a_plain") - F.col("b_plain"), F.col("a_weighted") - F.col("a_plain")
    db, end = F.col("b_weighted") - F.col("b_plain"), F.col("a_weighted") - F.col("b_weighted")
    steps = [(1, "plain advantage", gap, "total", F.lit(0.0), gap), (2, "A change", da, "change", gap + da, gap), (3, "B change", db, "change", gap + da, gap + da + db), (4, "weighted advantage", end, "total", F.lit(0.0), end)]
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s).alias("step"), v.alias("value"), F.lit(t).alias("kind"), lo.alias("ymin"), hi.alias("ymax")) for k, s, v, t, lo, hi in steps])
    fill = F.when(F.col("kind") == "total", "Total").when(F.col("value") < 0, "Decrease").otherwise("Increase")
    return df.select(F.inline(rows)).withColumns({"fill": fill, "label_y": (F.col("ymin") + F.col("ymax")) / 2})


def grid(levels: DataFrame, methods: DataFrame, upto: int) -> DataFrame:
    """Every method by level by x in 0..upto."""
    return methods.crossJoin(levels).select("method", "level", F.explode(F.sequence(F.lit(0), F.lit(upto))).alias("x"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal-width bins from 1; values outside go to 0 and bins + 1."""
    return df.select(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def trace(sections: dict[str, DataFrame], key: str) -> DataFrame:
    """(section, key, measure, value) of frames of a key and counts: a row a count, nulls included, so reports of any sections have one form."""
    long = []
    for name, df in sections.items():
        counts = [c for c in df.columns if c != key]
        rows = df.select(key, *[F.col(c).cast("long").alias(c) for c in counts]).unpivot([key], counts, "measure", "value")
        long.append(rows.select(F.lit(name).alias("section"), key, "measure", "value"))
    return reduce(DataFrame.unionAll, long)
