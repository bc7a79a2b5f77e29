"""Seeded draws: degree-matched sets for permutation tests, subsets for bootstraps."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .iterate import checkpointed, placed, ranked


def keyed_hash(*parts: Column | str) -> Column:
    """The md5 of the parts joined by colons: the same in any engine, so draws can be checked elsewhere."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def bootstrap(pool: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """(iter, node): for each iteration n nodes of the pool without replacement, those of the smallest hash; fewer in the pool raise ValueError."""
    have = pool.select("node").distinct()
    if have.count() < n:
        raise ValueError(f"the pool has fewer than {n} nodes")
    keyed = have.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = Window.partitionBy("iter").orderBy(keyed_hash(str(seed), F.col("iter").cast("string"), F.col("node")))
    return keyed.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).select("iter", "node")


#: Bands of the three matchers: (low, high) of a degree k.
def _band(mode: str, k: int, tolerance: float) -> tuple[int, int]:
    if mode == "M1":
        t = max(1, int(k * tolerance))
        return k - t, k + t
    if mode == "M2":
        return int(k * (1 - tolerance)), int(k * (1 + tolerance)) + 1
    return int(k * (1 - tolerance)), int(k * (1 + tolerance))


def bands(degrees: DataFrame, targets: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(target, node): nodes within the M1 band of each target's degree that are no targets.

    An equi-join on bins that double in width, of which a band meets three at most, and an exact filter: a hub's band
    costs no more rows than any other.
    """
    doubling = lambda d: F.floor(F.log2(F.greatest(d.cast("double"), F.lit(0.5))))
    t = degrees.join(targets.select("node").distinct(), "node", "left_semi")
    tol = F.greatest(F.lit(1), F.floor(F.col("degree") * tolerance)).cast("long")
    wide = t.select(F.col("node").alias("target"), (F.col("degree") - tol).alias("low"), (F.col("degree") + tol).alias("high"))
    wide = wide.withColumn("bin", F.explode(F.sequence(doubling(F.col("low")), doubling(F.col("high")))))
    free = degrees.join(targets.select("node").distinct(), "node", "left_anti").withColumn("bin", doubling(F.col("degree")))
    return wide.join(free, "bin").filter(F.col("degree").between(F.col("low"), F.col("high"))).select("target", "node")


#: Hashed tries at a place that is not used before the free ones are numbered.
_TRIES = 24
#: Rounds of a job, and permutations that are dealt to tasks together.
_ROUNDS, _CHUNK = 4, 16


def _roll(seed: int, n: Column, size: Column) -> Column:
    """A number below size by the md5 of seed, permutation, target and try."""
    word = F.conv(F.substring(keyed_hash(str(seed), F.col("perm_id").cast("string"), F.col("k").cast("string"), n.cast("string")), 1, 16), 16, 10)
    return (word.cast("decimal(20,0)") % F.greatest(size, F.lit(1)).cast("decimal(20,0)")).cast("long")


def _proposal(seed: int, n: Column) -> Column:
    return F.when(n < _TRIES, F.col("low") + _roll(seed, n, F.col("high") - F.col("low")))


def _round(state: DataFrame, seed: int, total: int, asked: int) -> DataFrame:
    """Each place keeps the least target that asks for it; the others ask for their next place, none after the last try."""
    # one number for permutation and place: it is sorted by its bits
    same = Window.partitionBy(F.col("perm_id") * F.lit(total + asked).cast("long") + F.coalesce("place", total + F.col("k")))
    told = state.withColumn("lost", ~F.col("sure") & (F.min("k").over(same) < F.col("k")))
    told = told.withColumn("n", F.col("n") + F.col("lost").cast("int"))
    return told.withColumn("place", F.when(F.col("lost"), _proposal(seed, F.col("n"))).otherwise(F.col("place")))


def _without_tries(state: DataFrame, seed: int, total: int, again: bool) -> DataFrame:
    """Rows whose tries are used up: where lesser targets hold the whole span the next span, else, for a permutation's least such target, one of the free places.

    Both stand: lesser targets are settled, and a place only ever passes to a lesser one.
    """
    stuck = state.filter("place is null").select("perm_id", F.col("k").alias("kk"), "low", "high")
    held = state.filter("place is not null").select("perm_id", "k", "place")
    near = (F.col("k") < F.col("kk")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    taken = checkpointed(stuck.join(held, "perm_id").filter(near).select("perm_id", F.col("kk").alias("k"), "place").distinct())
    counts = taken.groupBy("perm_id", "k").agg(F.count("*").alias("used"))
    stuck = stuck.withColumnRenamed("kk", "k").join(counts, ["perm_id", "k"], "left").withColumn("free", F.col("high") - F.col("low") - F.coalesce("used", F.lit(0)))
    least = stuck.groupBy("perm_id").agg(F.min("k").alias("k"))
    turn = stuck.join(least, ["perm_id", "k"], "left_semi").filter("free > 0").withColumn("r", _roll(seed, F.lit(_TRIES), F.col("free")))
    # a used place has place - low - (used places before it) free ones before it
    numbered = ranked(taken.join(turn.select("perm_id", "k", "low", "r"), ["perm_id", "k"]), ["perm_id", "k"], "place")
    passed = numbered.filter(F.col("place") - F.col("low") - (F.col("_k") - 1) <= F.col("r")).groupBy("perm_id", "k").agg(F.count("*").alias("passed"))
    given = turn.join(passed, ["perm_id", "k"], "left").select("perm_id", "k", (F.col("low") + F.col("r") + F.coalesce("passed", F.lit(0))).alias("given"))
    known = state.join(stuck.select("perm_id", "k", "free"), ["perm_id", "k"], "left").join(given, ["perm_id", "k"], "left")
    full = F.coalesce(F.col("free") == 0, F.lit(False))
    known = known.filter(~(full & (F.col("stage") == 1)))
    moved = known.withColumns({"low": F.when(full, 0).otherwise(F.col("low")), "high": F.when(full, total).otherwise(F.col("high")), "n": F.when(full, 0).otherwise(F.col("n")), "stage": F.when(full, 1).otherwise(F.col("stage"))})
    place = F.when(full, _proposal(seed, F.col("n"))).otherwise(F.coalesce("place", "given"))
    return moved.withColumns({"place": place, "sure": F.col("sure") | F.col("given").isNotNull() | (full & F.lit(again))}).select(*state.columns)


def degree_matched(degrees: DataFrame, targets: DataFrame, permutations: int, seed: int = 42, mode: str = "M1", tolerance: float = 0.25, n_sample: int | None = None, expressed: DataFrame | None = None) -> DataFrame:
    """(perm_id, k, node): for every permutation a node for each target, of like degree, drawn in target order without repeats.

    M1 excludes targets and falls back to any other node.  M2 does not exclude them and falls back to
    any node, drawn before or not.  M3 draws only expressed nodes and falls back to any of those.
    Where nothing is left a target has no row; targets that are no nodes have none either.

    Nodes that may be drawn have places in order of degree and name, so a target's band is a span of
    places.  A draw is a place, by a hash of seed, permutation, target and try: one that a lesser target of the permutation
    uses is tried anew, and after _TRIES the free places are numbered and one of them is taken, so each is as likely.

    All draws ask at once: a place keeps the least target that asks, the others ask for their next, until none
    moves.  As every place prefers the lesser target, that gives what drawing one target after another would.  A round is
    one shuffle by permutation and place, _ROUNDS are a job; a permutation's draws need not fit one task.  Only targets whose tries are
    used up wait for the lesser ones of their permutation.  The driver holds a count for every distinct degree.
    """
    if mode not in ("M1", "M2", "M3"):
        raise ValueError(f"unknown mode {mode}")
    if permutations < 1:
        raise ValueError("no permutations")
    spark = degrees.sparkSession
    wanted = targets.select("node").distinct()
    asked = placed(degrees.join(wanted, "node", "left_semi").select("node", "degree"), "node", place="k")
    asked = asked.filter(F.col("k") < n_sample) if mode == "M1" and n_sample is not None else asked
    pool = degrees.join(wanted, "node", "left_anti") if mode == "M1" else degrees
    if mode == "M3" and expressed is not None:
        pool = pool.join(expressed.select("node").distinct(), "node", "left_semi")
    pool = placed(pool.select("degree", "node"), "degree", "node")
    sizes = pool.groupBy("degree").agg(F.count("*").alias("n")).orderBy("degree").collect()
    order = np.array([r["degree"] for r in sizes], np.int64)
    starts = np.concatenate(([0], np.cumsum([r["n"] for r in sizes]))).astype(np.int64)
    total, again = int(starts[-1]), mode == "M2"
    rows = []
    for r in asked.select("degree").distinct().collect():
        low, high = _band(mode, int(r["degree"]), tolerance)
        rows.append((r["degree"], int(starts[np.searchsorted(order, low)]), int(starts[np.searchsorted(order, high, "right")])))
    spans = spark.createDataFrame(rows, "degree long, a long, b long")
    empty = F.col("b") <= F.col("a")
    # dealt in chunks of permutations before they are exploded, so that no task hashes the first draws of all
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = asked.join(spans, "degree").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // _CHUNK)))).repartition(tasks, "k", "chunk")
    last = F.least(F.col("chunk") * _CHUNK + _CHUNK - 1, F.lit(permutations - 1))
    draws = chunks.withColumn("perm_id", F.explode(F.sequence(F.col("chunk") * _CHUNK, last)))
    state = draws.select("perm_id", "k", F.when(empty, 1).otherwise(0).alias("stage"), F.when(empty, 0).otherwise(F.col("a")).cast("long").alias("low"), F.when(empty, total).otherwise(F.col("b")).cast("long").alias("high"), F.lit(0).alias("n"), (empty & F.lit(again)).alias("sure"))
    state = state.filter("high > low").withColumn("place", _proposal(seed, F.col("n")))
    count = asked.count()
    while True:
        for _ in range(_ROUNDS):
            state = _round(state, seed, total, count)
        state = checkpointed(state)
        if state.filter("lost").limit(1).count():
            continue
        if not state.filter("place is null").limit(1).count():
            break
        state = _without_tries(state, seed, total, again)
    return state.select("perm_id", "k", "place").join(pool.select("place", "node"), "place").select("perm_id", F.col("k").cast("int").alias("k"), "node")


def drawn_in_turn(degrees: DataFrame, targets: DataFrame, permutations: int, seed: int = 42, mode: str = "M1", tolerance: float = 0.25, n_sample: int | None = None, expressed: DataFrame | None = None) -> DataFrame:
    """The rows of degree_matched, drawn one target after another, a permutation in one task.

    For few targets in crowded bands, where nearly every draw runs out of tries and rounds would settle one a job.
    The driver and a task hold the targets' spans.
    """
    if mode not in ("M1", "M2", "M3"):
        raise ValueError(f"unknown mode {mode}")
    wanted = targets.select("node").distinct()
    asked = [r["degree"] for r in degrees.join(wanted, "node", "left_semi").orderBy("node").collect()]
    asked = asked[:n_sample] if mode == "M1" and n_sample is not None else asked
    pool = degrees.join(wanted, "node", "left_anti") if mode == "M1" else degrees
    if mode == "M3" and expressed is not None:
        pool = pool.join(expressed.select("node").distinct(), "node", "left_semi")
    pool = placed(pool.select("degree", "node"), "degree", "node")
    sizes = pool.groupBy("degree").agg(F.count("*").alias("n")).orderBy("degree").collect()
    order = np.array([r["degree"] for r in sizes], np.int64)
    starts = np.concatenate(([0], np.cumsum([r["n"] for r in sizes]))).astype(np.int64)
    limits = [_band(mode, int(k), tolerance) for k in asked]
    spans = [(int(starts[np.searchsorted(order, low)]), int(starts[np.searchsorted(order, high, "right")])) for low, high in limits]
    total = int(starts[-1])

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        perm, used, rows = int(frame["perm_id"].iloc[0]), set(), []

        def pick(k: int, a: int, b: int, again: bool = False) -> int | None:
            """A place from a to b, not used unless again, each as likely."""
            roll = lambda m, n: int.from_bytes(hashlib.md5(f"{seed}:{perm}:{k}:{n}".encode()).digest()[:8]) % m
            for n in range(_TRIES if b > a else 0):
                at = a + roll(b - a, n)
                if again or at not in used:
                    return at
            taken = sorted(x for x in used if a <= x < b)
            if b - a <= len(taken):
                return None
            at = a + roll(b - a - len(taken), _TRIES)
            for x in taken:
                at += x <= at
            return at

        for k, (a, b) in enumerate(spans):
            at = pick(k, a, b)
            at = pick(k, 0, total, mode == "M2") if at is None else at
            if at is not None:
                rows.append((perm, k, at))
                used.add(at)
        return pd.DataFrame(rows, columns=["perm_id", "k", "place"])

    spark = degrees.sparkSession
    ship(spark)
    perms = spark.range(permutations).select(F.col("id").cast("int").alias("perm_id"))
    drawn = perms.groupBy("perm_id").applyInPandas(draw, "perm_id int, k int, place long")
    return drawn.join(pool.select("place", "node"), "place").select("perm_id", "k", "node")
