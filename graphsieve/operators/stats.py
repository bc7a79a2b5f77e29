"""z-scores, empirical and Gaussian p-values, false discovery rates, bootstrap summaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import checkpointed, ranked

TAILS = ("one_greater", "one_less", "two")


def z_score(observed: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (observed - mean) / std).otherwise(0.0)


def empirical_p(observed: Column, null: Column, tail: str = "one_greater") -> Column:
    """Aggregate: (r + 1) / (n + 1) over the non-null null values; two-sided is twice the lesser, not cut at 1; none gives null."""
    if tail not in TAILS:
        raise ValueError(f"unknown tail {tail}")
    n = F.count(null)
    up, down = ((F.count_if(c) + 1) / (n + 1) for c in (null >= observed, null <= observed))
    return F.when(n > 0, {"one_greater": up, "one_less": down, "two": 2 * F.least(up, down)}[tail])


#: Coefficients, from the highest power down, of the rational form of the normal tail (Hart's algorithm 5666, 15 digits).
_ABOVE = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_BELOW = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def _upper_tail(x: Column) -> Column:
    """1 - Phi(x) for x >= 0: a rational form up to 7, a continued fraction beyond."""
    poly = lambda cs: reduce(lambda acc, c: acc * x + c, cs[1:], F.lit(cs[0]))
    bell = F.exp(-x * x / 2)
    fraction = reduce(lambda acc, k: x + k / acc, (4, 3, 2, 1), x + 0.65)
    return F.when(x < 7, bell * poly(_ABOVE) / poly(_BELOW)).when(x.isNotNull(), bell / fraction / math.sqrt(2 * math.pi))


def gaussian_p(z: Column, tail: str = "two") -> Column:
    """2 (1 - Phi(|z|)) for two, else 1 - Phi(z); a null z gives null.  Spark has no error function: plain arithmetic, good to about 1e-14."""
    upper = _upper_tail(F.abs(z))
    return 2 * upper if tail == "two" else F.when(z < 0, 1 - upper).otherwise(upper)


def null_summary(null: DataFrame, observed: DataFrame, by: list[str], tail: str = "one_greater") -> DataFrame:
    """(by..., observed, null_mean, null_std, z_score, p_value): null (by..., value), observed (by..., observed); population deviation."""
    agg = observed.join(null, by, "left").groupBy(*by, "observed").agg(
        F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"), empirical_p(F.col("observed"), F.col("value"), tail).alias("p_value")
    )
    return agg.select(*by, "observed", "null_mean", "null_std", z_score(F.col("observed"), F.col("null_mean"), F.col("null_std")).alias("z_score"), "p_value")


def bh(df: DataFrame, family: list[str], p: str = "p_value", out: str = "p_fdr") -> DataFrame:
    """df with Benjamini-Hochberg q-values within each family; a null p counts as 1.

    A q is the least p m / k of its rank and the ranks above.  Ranks are counted by range (``ranked``), and the least
    of a range's later rows is carried to it by range, so a family of all rows is no task of its own.
    """
    r = checkpointed(ranked(df.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0))), family, "_p").withColumn("_v", F.col("_p") * F.col("_m") / F.col("_k")))
    later = Window.partitionBy("_group").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = r.groupBy("_group", "_range").agg(F.min("_v").alias("_least")).select("_group", "_range", F.min("_least").over(later).alias("_carried"))
    within = Window.partitionBy("_group", "_range").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("_v").over(within), F.col("_carried"))
    return r.join(carried, ["_group", "_range"]).withColumn(out, q).select(*df.columns, *([out] if out not in df.columns else []))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by..., n, q0, q1, ...): the exact quantiles of the non-null values of each group, between neighbours by linear interpolation.

    Values are numbered by range (``ranked``) and the two neighbours of each share are picked by their numbers: no
    group's values meet in one task or buffer.  A group without values is left out.
    """
    r = ranked(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x")), by, "_x")
    at = [F.lit(q) * (F.col("_m") - 1) for q in shares]
    wanted = reduce(lambda a, b: a | b, [(F.col("_k") - 1 == F.floor(a)) | (F.col("_k") - 1 == F.ceil(a)) for a in at])
    pick = lambda where: F.max(F.when(where, F.col("_x")))
    cols = []
    for i, a in enumerate(at):
        low, high, part = pick(F.col("_k") - 1 == F.floor(a)), pick(F.col("_k") - 1 == F.ceil(a)), F.max(a - F.floor(a))
        cols.append((low + (high - low) * part).alias(f"q{i}"))
    return r.filter(wanted).groupBy(*by).agg(F.max("_m").alias("n"), *cols)


def bootstrap_summary(draws: DataFrame, observed: Column, by: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation, exact 95 % interval (``quantiles``), whether observed exceeds it, and observed over the mean."""
    v = F.col(value)
    draws = checkpointed(draws.withColumn("_observed", observed))
    interval = quantiles(draws, by, value, [0.025, 0.975]).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("q0").alias("ci_lower"), F.col("q1").alias("ci_upper"))
    whole = draws.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n_bootstrap"), F.max("_observed").alias("observed"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    out = whole.join(F.broadcast(interval) if not by else interval, same, "left").select(*by, "mean", "std", "ci_lower", "ci_upper", "n_bootstrap", "observed")
    return out.withColumns({"exceeds_ci": F.col("observed") > F.col("ci_upper"), "fold": F.col("observed") / F.col("mean")})


def density(df: DataFrame, value: str, points: int = 512, reach: float = 4.0) -> DataFrame:
    """(x, density) of the non-null values at evenly spaced points: a Gaussian kernel over values shared between their two nearest points.

    The bandwidth is 0.9 min(deviation, interquartile range / 1.34) n^(-1/5) (of the two, the one that is not 0; else 1), the points go from
    three bandwidths under the least value to three over the greatest, and the kernel ends at ``reach`` bandwidths.  One pass counts
    the values by point; after that rows are points, of which there are as many as the parameter says.  No values give no rows.
    """
    x = checkpointed(df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x")))
    whole = x.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("s")).join(F.broadcast(quantiles(x, [], "x", [0.25, 0.75])).drop("n"))
    spread = F.coalesce(F.nullif(F.least(F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(math.inf)), F.coalesce(F.nullif((F.col("q1") - F.col("q0")) / 1.34, F.lit(0.0)), F.lit(math.inf))), F.lit(math.inf)), F.lit(1 / 0.9))
    whole = whole.withColumn("h", F.lit(0.9) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    whole = checkpointed(whole.select("n", "h", (F.col("low") - 3 * F.col("h")).alias("start"), ((F.col("high") - F.col("low") + 6 * F.col("h")) / (points - 1)).alias("step")))
    at = x.join(F.broadcast(whole)).select(((F.col("x") - F.col("start")) / F.col("step")).alias("at"), F.floor((F.col("x") - F.col("start")) / F.col("step")).alias("i"))
    shares = at.select(F.explode(F.array(F.struct(F.col("i").alias("i"), (1 - (F.col("at") - F.col("i"))).alias("c")), F.struct((F.col("i") + 1).alias("i"), (F.col("at") - F.col("i")).alias("c")))).alias("s")).select("s.i", "s.c")
    binned = shares.groupBy("i").agg(F.sum("c").alias("c")).join(F.broadcast(whole))
    wide = F.ceil(reach * F.col("h") / F.col("step"))
    near = binned.withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("i") - wide), F.least(F.lit(points - 1).cast("long"), F.col("i") + wide))))
    z = (F.col("j") - F.col("i")) * F.col("step") / F.col("h")
    bell = F.when(F.abs(z) <= reach, F.exp(-z * z / 2) / math.sqrt(2 * math.pi)).otherwise(0.0)
    return near.groupBy("j", "start", "step").agg(F.sum(F.col("c") * bell / (F.col("n") * F.col("h"))).alias("density")).select((F.col("start") + F.col("j") * F.col("step")).alias("x"), "density")
