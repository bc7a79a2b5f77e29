"""Set similarity of bit fingerprints and its summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .iterate import checkpointed

#: Fingerprints of a block, about: a task holds a block of tests and one of references.
BLOCK = 1 << 14
#: Tests and references compared at once within a tile.
_ROWS, _COLUMNS = 8, 4096


def tanimoto(a: Column, b: Column) -> Column:
    """Of two arrays of distinct on-bits; two empty ones give 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def tanimoto_words(a: Column, b: Column) -> Column:
    """Of two bit vectors as arrays of 64-bit words."""
    count = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda s, x: s + F.bit_count(x))
    both, union = count(lambda x, y: x.bitwiseAND(y)), count(lambda x, y: x.bitwiseOR(y))
    return F.when(union > 0, both / union).otherwise(0.0)


def fold(tokens: Column, size: int = 2048) -> Column:
    """Tokens as sorted distinct bits of a hashed fingerprint."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % size)))


def pairs(tests: DataFrame, references: DataFrame) -> DataFrame:
    """(compound, reference, category, similarity) of tests (compound, bits) by references (reference, category, bits).

    Every test meets every reference: that is the control's question.  The tests are the small side.
    """
    return references.withColumnRenamed("bits", "rbits").crossJoin(F.broadcast(tests)).select("compound", "reference", "category", tanimoto(F.col("bits"), F.col("rbits")).alias("similarity"))


def _met(threshold: float):
    """A function from a tile's rows to its pairs (compound, reference, category, both, union) that reach the threshold."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).sort_by("size")
        sides = [whole.filter(pc.equal(whole["side"], k)).combine_chunks() for k in (0, 1)]
        if not all(x.num_rows for x in sides):
            return
        size = [x["size"].to_numpy().astype(np.int64) for x in sides]
        flat = [pc.list_flatten(x["bits"]).to_numpy() for x in sides]
        at = [np.repeat(np.arange(len(n)), n) for n in size]
        # bits that no test of the tile holds are left out
        have = np.unique(flat[0])
        words = [np.zeros((-(-len(have) // 64), len(n)), np.uint64) for n in size]
        for k in (0, 1):
            place = np.minimum(np.searchsorted(have, flat[k]), len(have) - 1)
            known = have[place] == flat[k]
            np.bitwise_or.at(words[k], (place[known] >> 6, at[k][known]), np.uint64(1) << (place[known] & 63).astype(np.uint64))
        kind = np.uint16 if len(have) < 1 << 16 else np.uint32
        for i in range(0, len(size[0]), _ROWS):
            a = size[0][i : i + _ROWS, None]
            low, high = np.searchsorted(size[1], a[0, 0] * threshold - 1e-9), np.searchsorted(size[1], a[-1, 0] / threshold + 1e-9, "right")
            for j in range(low, high, _COLUMNS):
                b = size[1][None, j : min(j + _COLUMNS, high)]
                both = np.zeros((len(a), b.shape[1]), kind)
                for x, y in zip(*words, strict=True):
                    both += np.bitwise_count(x[i : i + len(a), None] & y[None, j : j + b.shape[1]])
                r, c = np.nonzero(both >= (a + b) * (threshold / (1 + threshold)) - 1e-6)
                n = both[r, c].astype(np.int64)
                union = a[r, 0] + b[0, c] - n
                hit = n / union >= threshold
                if hit.any():
                    r, c, n, union = r[hit] + i, c[hit] + j, n[hit], union[hit]
                    pairs = [sides[0]["compound"].take(pa.array(r)), sides[1]["reference"].take(pa.array(c)), sides[1]["category"].take(pa.array(c)), pa.array(n), pa.array(union)]
                    yield from pa.table(pairs, names=["compound", "reference", "category", "both", "union"]).combine_chunks().to_batches()

    return met


def analogs(tests: DataFrame, references: DataFrame, threshold: float = 0.4, block: int = BLOCK) -> DataFrame:
    """(compound, reference, category, similarity) of all pairs that reach the threshold (above 0).

    Both sides are dealt into blocks by a hash of the name, and each block of tests meets each block of references in a tile of its own,
    as words of bits whose common ones are counted.  A row is sent once for each block of the other side, and nothing is sent or kept
    for a pair that does not reach the threshold.  Within a tile rows are in order of size, and only sizes that differ by a factor of
    the threshold at most are compared.
    Empty and null sets have no bit and reach nothing; repeated rows of tests or references must have names of their own.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    ship(tests.sparkSession)
    # the bits, once computed, are read twice: for the number of blocks and for the tiles
    a, b = (checkpointed(df.filter(F.size("bits") > 0)) for df in (tests.select("compound", "bits"), references.select("reference", "category", "bits")))
    fans = [max(1, -(-x.count() // block)) for x in (a, b)]
    dealt = lambda name, fan: F.pmod(F.xxhash64(name), F.lit(fan)).cast("int")
    each = lambda fan: F.explode(F.sequence(F.lit(0), F.lit(fan - 1)))
    a = a.select(dealt("compound", fans[0]).alias("row"), each(fans[1]).alias("column"), F.lit(0).alias("side"), F.size("bits").alias("size"), "compound", "bits")
    b = b.select(dealt("reference", fans[1]).alias("column"), each(fans[0]).alias("row"), F.lit(1).alias("side"), F.size("bits").alias("size"), "reference", "category", "bits")
    rows = a.unionByName(b, allowMissingColumns=True).repartition(fans[0] * fans[1], "row", "column")
    kinds = T.StructType([*(rows.schema[c] for c in ("compound", "reference", "category")), T.StructField("both", T.LongType()), T.StructField("union", T.LongType())])
    found = rows.groupBy("row", "column").applyInArrow(_met(threshold), kinds)
    return found.select("compound", "reference", "category", (F.col("both") / F.col("union")).alias("similarity"))


def summary(scored: DataFrame, threshold: float = 0.4) -> DataFrame:
    """One row a compound: count, mean, max and population deviation for either category, and whether a positive reaches the threshold."""
    out = []
    for name in ("positive", "negative"):
        s = F.when(F.col("category") == name, F.col("similarity"))
        out += [F.count(s).alias(f"n_{name}"), F.avg(s).alias(f"mean_{name}"), F.max(s).alias(f"max_{name}"), F.stddev_pop(s).alias(f"std_{name}")]
    return scored.groupBy("compound").agg(*out).withColumn("analog", F.coalesce(F.col("max_positive") >= threshold, F.lit(False)))


def resolve(references: DataFrame, cache: DataFrame) -> DataFrame:
    """references (reference, category) with smiles of the cache (name, smiles); known misses (empty) and unknown names go."""
    known = cache.select(F.col("name").alias("reference"), F.nullif("smiles", F.lit("")).alias("smiles"))
    return references.join(known, "reference", "left").filter(F.col("smiles").isNotNull())
