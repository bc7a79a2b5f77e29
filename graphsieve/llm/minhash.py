"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Work, batched, map_arrow, parts_of, row_key, small, table
from .components import components

BITS = 4
#: Minima of the long signatures with which pairs of unsettled buckets are compared.
LONG = 1024
_NIBBLES = np.uint64(0x1111111111111111)


@dataclass(frozen=True)
class Scheme:
    """bands of rows minima each; a pair of similarity s shares no band with probability (1 - s**rows)**bands.

    At 6 x 32 that is 3e-7 for 0.85 and 6e-5 for 0.8.
    """

    width: int = 5
    rows: int = 6
    bands: int = 32
    seed: int = 3

    @property
    def size(self) -> int:
        return self.rows * self.bands

    def longer(self) -> Scheme:
        """Other hash functions, for signatures only: the estimate's deviation falls with the root of their number."""
        return Scheme(self.width, LONG, 1, self.seed + 1)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 2**64, (self.size, 1), dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, (self.size, 1), dtype=np.uint64)

    def floor(self, similarity: float) -> float:
        """The estimate that a pair of that similarity falls below with probability 3e-5 (four standard deviations)."""
        match = similarity + (1 - similarity) * 2.0**-BITS
        return similarity - 4 * (match * (1 - match) / self.size) ** 0.5 / (1 - 2.0**-BITS)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, 32 bits each."""
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[None, i : i + 1024] * a + b).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def pack(low: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen to a 64-bit word."""
    nibbles = np.zeros(-(-len(low) // 16) * 16, np.uint8)
    nibbles[: len(low)] = low & 15
    return (nibbles[0::2] | (nibbles[1::2] << 4)).view(np.uint64)


def estimate(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Collision-corrected similarity of packed signatures, by counting unequal groups of bits."""
    d = x ^ y
    d = d | (d >> np.uint64(1))
    d = d | (d >> np.uint64(2))
    unequal = np.bitwise_count(d & _NIBBLES).sum(axis=-1)
    return 1 - unequal / size / (1 - 2.0**-BITS)


def signatures(docs: DataFrame, scheme: Scheme, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, cls, sig, bands): key of id and text, number of shingles, digest of the set, packed signature, band keys (null without shingles)."""
    bands = scheme.bands

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = scheme.hashes()
        n, cls, sig, keys = [], [], [], []
        for _, _, data, offs in K.chunks(batch["text"]):
            for s in K.shingle_sets(K.Words(data, offs), scheme.width):
                n.append(len(s))
                if not len(s):
                    cls.append(None), sig.append(None), keys.append(None)
                    continue
                low = minima(s, a, b)
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(pack(low).tobytes())
                keys.append(_band_keys(low, bands))
        return pa.record_batch({"id": batch["id"], "row": batch["row"], "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()), "sig": pa.array(sig, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return map_arrow(rows, sign, "id long, row binary, n long, cls binary, sig binary, bands array<long>")


def _band_keys(low: np.ndarray, bands: int) -> np.ndarray:
    rows = low.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = K.mix(key * np.uint64(31) + rows[:, j] + np.uint64(j << 40))
    return key.view(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in names, of sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in names])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[i].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _long_signatures(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(v, sig) of rows (id, text)."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = scheme.hashes()
        sig = [pack(minima(s, a, b)).tobytes() for _, _, data, offs in K.chunks(batch["text"]) for s in K.shingle_sets(K.Words(data, offs), scheme.width)]
        return pa.record_batch({"v": batch["id"], "sig": pa.array(sig, pa.binary())})

    return map_arrow(rows.select("id", "text"), sign, "v long, sig binary")


def verify(pairs: DataFrame, texts: DataFrame, scheme: Scheme, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets have percent * union <= 100 * intersection.

    texts: (id, text).  The set of a is made once for every 256 partners at most: a document with very
    many partners is dealt to several tasks, and a task holds one set and one batch at a time.
    """
    sized = pairs.join(small(pairs.groupBy("a").agg(F.count("*").alias("n"))), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 256)).cast("int").alias("part"))
    hubs = sized.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.lit(0).alias("role"), "id", "text")
    spokes = sized.join(texts, F.col("b") == F.col("id")).select("a", "part", F.lit(1).alias("role"), "id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, role, ids = batch["a"].to_numpy(), batch["role"].to_numpy(), batch["id"].to_numpy()
            good = np.zeros(len(a), bool)
            k = 0
            for _, _, data, offs in K.chunks(batch["text"]):
                for s in K.shingle_sets(K.Words(data, offs), scheme.width):
                    if role[k] == 0:
                        hub, own = a[k], s
                    elif hub == a[k]:
                        both = np.concatenate((own, s))
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        good[k] = common > 0 and 100 * common >= percent * (len(both) - common)
                    k += 1
            yield pa.record_batch({"a": pa.array(a[good]), "b": pa.array(ids[good])})

    dealt = hubs.unionAll(spokes).repartition(parts_of(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "role")
    return dealt.mapInArrow(compare, "a long, b long")


def _estimated(pairs: DataFrame, reps: DataFrame, scheme: Scheme, floor: float) -> DataFrame:
    """The pairs (a, b) whose signatures estimate a similarity of floor or more."""
    size = scheme.size
    signed = pairs.join(reps.select(F.col("v").alias("b"), F.col("sig").alias("sb")), "b").join(reps.select(F.col("v").alias("a"), F.col("sig").alias("sa")), "a")

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        return batch.select(["a", "b"]).filter(pa.array(estimate(x, y, size) >= floor))

    return map_arrow(signed.select("a", "b", "sa", "sb"), pick, "a long, b long")


def _across(members: DataFrame, labels: DataFrame, reps: DataFrame, texts, scheme: Scheme, similarity: float, work: Work) -> DataFrame:
    """Candidate pairs whose ends are still in different components, for every band that they share.

    In a bucket the largest component's members need no comparing among themselves: each of the others
    meets every member.  Buckets are cut into tiles (512 members by 2048 of the others), so no task
    holds a whole bucket; a tile compares packed signatures and gives out only pairs estimated within
    four deviations, each in the first band that both share.  Only members of unsettled buckets are
    signed for this, at length, so that few pairs that are no links are left to be confirmed.
    """
    longer = scheme.longer()
    floor = longer.floor(similarity)
    size = longer.size
    labelled = members.join(small(labels.withColumnRenamed("comp", "c")), "v", "left").select("band", "key", "v", F.coalesce("c", "v").alias("c"))
    labelled = work.stage(labelled, "labelled")
    each = labelled.groupBy("band", "key", "c").agg(F.count("*").alias("n"))
    open_ = each.groupBy("band", "key").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("c", "n").alias("major")).filter("k > 1")
    open_ = open_.select("band", "key", "major", F.ceil(F.col("n") / 512).cast("int").alias("rows"), F.ceil((F.col("n") - F.col("top")) / 2048).cast("int").alias("cols"))
    open_ = work.stage(open_, "buckets_open")
    rows = work.stage(labelled.join(small(open_), ["band", "key"]), "open")
    signed = work.stage(_long_signatures(texts(rows.select("v").distinct(), "open_texts"), longer), "long")
    reps = reps.select("v", "bands").join(signed, "v")
    home, col = F.pmod(F.xxhash64("v"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("v", F.lit(1)), F.col("cols")).cast("int")
    range_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = rows.select("band", "key", "v", "c", (F.col("c") != F.col("major")).alias("minor"), home.alias("x"), range_("cols").alias("y"), F.lit(0).alias("role"))
    minors = rows.filter("c <> major").select("band", "key", "v", "c", F.lit(True).alias("minor"), range_("rows").alias("x"), col.alias("y"), F.lit(1).alias("role"))
    tiles = whole.unionAll(minors).join(reps.select("v", "sig", "bands"), "v").repartition(parts_of(members.sparkSession), "band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y", "role")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["band", "key", "x", "y"]):
            role = group["role"].to_numpy()
            cut = int((role == 0).sum())
            if not 0 < cut < len(role):
                continue
            v, c, minor, band = group["v"].to_numpy(), group["c"].to_numpy(), group["minor"].to_numpy(), group["band"][0].as_py()
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint64).reshape(len(v), -1)
            keys = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(v), -1)[:, :band]
            left, right = [], []
            for i in range(cut):
                ok = (c[cut:] != c[i]) & ((v[cut:] > v[i]) | (not minor[i]))
                at = np.flatnonzero(ok) + cut
                at = at[estimate(sig[at], sig[i], size) >= floor]
                if len(at):
                    at = at[~(keys[at] == keys[i]).any(axis=1)] if band else at
                    left += [int(v[i])] * len(at)
                    right += v[at].tolist()
            if left:
                yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    found = tiles.select("band", "key", "x", "y", "role", "v", "c", "minor", "sig", "bands").mapInArrow(match, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, scheme: Scheme | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, row, stays) of every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets of word shingles;
    component_id is the smallest id reachable over links.  Equal sets are one class, a vertex of the search; its smallest id
    stands for it.  Bands of minima give candidate pairs, bit counts of packed signatures an estimate,
    and pairs estimated within four standard deviations are confirmed on their full sets.  First each
    bucket's members are compared with its smallest; then pairs of a bucket that are still in
    different components.  So a large group of copies costs about a comparison a member, and no
    link between components is left out.

    Null or empty texts and texts without words have no shingles and stay alone; texts of fewer words
    than the width are one shingle.  Every row is a document: rows of one id with unlike texts are each linked by their
    own text, and components are told apart even where they have the same smallest id.  A null id is linked
    with nothing: its component is null and it is kept.  An empty table gives an empty result.

    row is row_key(id, text); stays is set for one row of each component (the smallest id, of its rows the one of the smallest key;
    rows that repeat id and text have it together) and for rows without shingles or id.
    """
    scheme = scheme or Scheme()
    spark = docs.sparkSession
    batched(spark)
    work, floor = Work(spark, "minhash"), scheme.floor(percent / 100)
    signed = work.stage(signatures(docs, scheme, id_col, text_col), "signed")
    full = signed.filter("n > 0 and id is not null")
    found = work.stage(full.groupBy("cls").agg(F.min(F.struct("id", "row")).alias("top")), "found")
    shared = work.stage(found.groupBy("top.id").agg(F.min("cls").alias("first"), F.count("*").alias("k")).filter("k > 1").select("id", "first"), "shared")
    # a class is named by its smallest id, further classes with the same one by a hash of their digest
    named = found.select("cls", "top", F.col("top.id").alias("id")).join(small(shared), "id", "left")
    classes = work.stage(named.select("cls", "top", F.when(F.col("first").isNull() | (F.col("first") == F.col("cls")), F.col("id")).otherwise(F.xxhash64("cls")).alias("v")), "classes")
    reps = full.join(classes.select("cls", F.col("top.row").alias("row"), "v"), ["cls", "row"])
    reps = work.stage(reps.dropDuplicates(["v"]).select("v", "row", "sig", "bands"), "reps")
    banded = reps.select("v", F.posexplode("bands").alias("band", "key"))
    buckets = work.stage(banded.groupBy("band", "key").agg(F.min("v").alias("a"), F.max("v").alias("z")).filter("a < z").select("band", "key", "a"), "buckets")
    members = work.stage(banded.join(small(buckets), ["band", "key"]), "members")
    stars = members.filter("v <> a").select("a", F.col("v").alias("b")).distinct()
    stars = work.stage(_estimated(stars, reps, scheme, floor), "stars")
    source = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def texts(some: DataFrame, name: str) -> DataFrame:
        """(id, text) of the classes (v)."""
        rows = work.stage(some.join(reps.select("v", "row"), "v"), name)
        return source.join(small(rows), "row").select(F.col("v").alias("id"), "text").dropDuplicates(["id"])

    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    links = work.stage(verify(stars, texts(ends(stars), "star_ends"), scheme, percent), "links")
    labels = work.stage(components(links, work, "near"), "labels")
    rest = work.stage(_across(members, labels, reps, texts, scheme, percent / 100, work), "rest")
    more = work.stage(verify(rest, texts(ends(rest), "rest_ends"), scheme, percent), "more")
    if more.limit(1).count():
        labels = work.stage(components(links.unionAll(more), work, "all"), "final")
    linked = labels.join(classes.select("v", "top"), "v")
    tops = work.stage(linked.groupBy("comp").agg(F.min("top").alias("least")).join(labels, "comp").select("v", "least"), "tops")
    named = work.stage(classes.join(small(tops), "v", "left").select("cls", F.coalesce("least", "top").alias("least")), "named")
    out = signed.select("id", "row", "n", "cls").join(named, "cls", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least.id", "id"))
    alone = F.col("least").isNull() | F.col("id").isNull()
    out = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "row", (alone | (F.col("row") == F.col("least.row"))).alias("stays"))
    out = work.stage(out, "out")
    work.drop("signed", "found", "shared", "classes", "reps", "buckets", "members", "labelled", "buckets_open", "open", "open_texts", "long", "stars", "star_ends", "links", "labels", "rest", "rest_ends", "more", "final", "tops", "named")
    return out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with similarity 0.85 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, percent=85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
