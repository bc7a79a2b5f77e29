"""Blocked sparse matrices: walks of many columns and searches from many sources, some steps a job.

Nodes are numbered and cut into blocks.  A matrix is kept as tiles, the entries of a block of columns by block of rows,
cached where their columns' block lives; a column block with very many entries is split by rows into parts.  The state of a loop is one
Arrow row a block and part with the block's values of all columns.  A step is one cogroup: a block takes the partial results sent to it,
makes its new values, and sends each row block what its tiles make of them.  So a step shuffles partial results only, sums of a
row are combined before they are sent, and no task holds more than one block, one part's tiles and the partial results for one block.

A chunk of steps is one job; its result is checkpointed in the shared folder.  Each step's change is summed per column, and
a chunk in which a column stops is run again from the last checkpoint with that many steps for the column: results
are those of a check after every step, whatever the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .iterate import checkpointed, placed

#: Nodes of a block at least and at most, entries of a part of a column block, and numbers handled at once in a product.
LEAST_BLOCK, MOST_BLOCK, PART_ENTRIES, AT_ONCE = 64, 1 << 20, 4_000_000, 4_000_000
#: Entries that a task handles in a step: small graphs take few tasks, two at least, large ones the session's number of partitions.
TASK_ENTRIES = 500_000
#: Numbers in a block's values: blocks of many columns hold fewer nodes.
BLOCK_VALUES = 1 << 22
_TILE = "block int, part int, row_block int, n int, fan int, rows binary, ends binary, cols binary, weights binary"
_STATE = "block int, part int, kind int, idx binary, val binary, log binary"
_STATE_FIELDS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("idx", pa.binary()), ("val", pa.binary()), ("log", pa.binary())])


def _ints(scalar: pa.Scalar, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), kind)


@dataclass
class Tiled:
    """The tiles (cached), the nodes' numbers (node, place), their count, nodes of a block, and partitions of a step."""

    tiles: DataFrame
    numbers: DataFrame
    n: int
    size: int
    parts: int

    def release(self) -> None:
        self.tiles.unpersist()


def numbered(nodes: DataFrame) -> DataFrame:
    """(node, place): the nodes in order from 0."""
    return checkpointed(placed(nodes.select("node").distinct(), "node"))


def tiled(entries: DataFrame, numbers: DataFrame, start: DataFrame, columns: int, size: int | None = None, part_entries: int = PART_ENTRIES) -> Tiled:
    """Tiles of entries (to, from, w): the value of ``to`` takes w times that of ``from``; ends that are no numbered nodes are left out.

    start (node, col, b): the columns' constant terms, which also are their first values; columns is their number.
    The size of a block depends on the nodes, the entries, the columns and the session's number of shuffle partitions; results don't.
    """
    spark = entries.sparkSession
    ship(spark)
    a, b = numbers.select(F.col("node").alias("from"), F.col("place").alias("c")), numbers.select(F.col("node").alias("to"), F.col("place").alias("r"))
    located = checkpointed(entries.join(a, "from").join(b, "to").select("c", "r", F.col("w").cast("double").alias("w")))
    n, total = numbers.count(), located.count()
    parts = max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * columns // TASK_ENTRIES)))
    size = size or min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // parts)), max(LEAST_BLOCK, BLOCK_VALUES // max(columns, 1)))
    at = located.select((F.col("c") / size).cast("int").alias("block"), (F.col("c") % size).cast("int").alias("c"), (F.col("r") / size).cast("int").alias("row_block"), (F.col("r") % size).cast("int").alias("r"), "w")
    counted = at.groupBy("block").agg(F.count("*").alias("entries"))
    blocks = spark.range(-(-n // size)).select(F.col("id").cast("int").alias("block")).join(counted, "block", "left")
    fans = checkpointed(blocks.select("block", F.greatest(F.lit(1), F.ceil(F.coalesce("entries", F.lit(0)) / part_entries)).cast("int").alias("fan")))
    # a row of fans a block: bounded by nodes over the block size, not by edges
    keyed = at.join(F.broadcast(fans), "block").withColumn("part", F.pmod(F.xxhash64("row_block", "r"), F.col("fan")).cast("int")).drop("fan")
    keyed = keyed.join(F.broadcast(fans.toDF("row_block", "fan")), "row_block").select("block", "part", "row_block", "fan", "r", "c", "w")

    def pack(table: pa.Table) -> pa.Table:
        block, part = table["block"][0].as_py(), table["part"][0].as_py()
        home, r, c, w, fan = (table[x].to_numpy() for x in ("row_block", "r", "c", "w", "fan"))
        order = np.lexsort((c, r, home))
        home, r, c, w, fan = home[order], r[order], c[order], w[order], fan[order]
        cuts = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
        out = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            first = np.concatenate(([0], np.flatnonzero(np.diff(r[i:j])) + 1))
            out.append((block, part, int(home[i]), None, int(fan[i]), r[i:j][first].astype("<i4").tobytes(), first.astype("<i8").tobytes(), c[i:j].astype("<i4").tobytes(), w[i:j].astype("<f8").tobytes()))
        names = [x.split()[0] for x in _TILE.split(", ")]
        kinds = [pa.int32()] * 5 + [pa.binary()] * 4
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    terms = start.join(numbers, "node").select((F.col("place") / size).cast("int").alias("block"), (F.col("place") % size).cast("int").alias("i"), F.col("col").cast("int").alias("col"), F.col("b").cast("double").alias("b"))
    terms = terms.filter("b <> 0")

    def constant(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        i, col, value = (table[x].to_numpy() for x in ("i", "col", "b"))
        order = np.lexsort((col, i))
        return pa.table({"block": pa.array([block], pa.int32()), "rows": pa.array([i[order].astype("<i4").tobytes()], pa.binary()), "cols": pa.array([col[order].astype("<i4").tobytes()], pa.binary()), "weights": pa.array([value[order].astype("<f8").tobytes()], pa.binary())})

    held = fans.join(terms.groupBy("block").applyInArrow(constant, "block int, rows binary, cols binary, weights binary"), "block", "left")
    count = F.least(F.lit(size), F.lit(n) - F.col("block").cast("long") * size).cast("int")
    heads = held.select("block", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.lit(-1).alias("row_block"), count.alias("n"), "fan", "rows", F.lit(None).cast("binary").alias("ends"), "cols", "weights")
    rows = keyed.groupBy("block", "part").applyInArrow(pack, _TILE).unionAll(heads)
    return Tiled(rows.repartition(parts, "block", "part").sortWithinPartitions("block", "part").persist(), numbers, n, size, parts)


def _split(left: pa.Table) -> tuple[int, list[int], int]:
    """The row of left that is the block's head, the others, and the number of the block's nodes."""
    homes = left["row_block"].to_pylist()
    head = homes.index(-1)
    return head, [k for k in range(len(homes)) if k != head], left["n"][head].as_py()


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATE_FIELDS, strict=True)], schema=_STATE_FIELDS)


def _products(left: pa.Table, tiles: list[int], x: np.ndarray, reduce: np.ufunc, times: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row block, its parts, rows, values) of each tile times x; reduce joins a row's values."""
    width = max(1, AT_ONCE // max(1, x.shape[1]))
    for k in tiles:
        rows, first, cols = _ints(left["rows"][k]), _ints(left["ends"][k], "<i8"), _ints(left["cols"][k])
        w = _ints(left["weights"][k], "<f8")[:, None] if times else None
        out = np.empty((len(rows), x.shape[1]), x.dtype)
        ends = np.append(first[1:], len(cols))
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, first[i] + width, "right")))
            got = x[cols[first[i] : ends[j - 1]]]
            out[i:j] = reduce.reduceat(got * w[first[i] : ends[j - 1]] if times else got, first[i:j] - first[i], axis=0)
            i = j
        yield left["row_block"][k].as_py(), left["fan"][k].as_py(), rows, out


def _run(t: Tiled, state: DataFrame, steps: int, step: Callable[[int, bool], Callable]) -> DataFrame:
    """The state after so many steps, as one checkpointed job; state is empty or a state that was returned."""
    conf, left = t.tiles.sparkSession.conf, t.tiles.groupBy("block", "part")
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(t.parts))  # the partitions of the tiles, so that they are never shuffled; as before when the job is done
    try:
        for s in range(steps + 1):
            state = left.cogroup(state.groupBy("block", "part")).applyInArrow(step(s, s < steps), _STATE)
        return checkpointed(state)
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def _logs(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of all blocks' logs: added up within partitions first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)))
        for batch in batches:
            for x in batch["log"]:
                total += _ints(x, "<f8")
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["log"])

    rows = state.filter("part = 0 and kind = 0").select("log").mapInArrow(add, "log binary").collect()
    return sum((np.frombuffer(r["log"], "<f8") for r in rows), np.zeros(int(np.prod(shape)))).reshape(shape)


def walk(t: Tiled, columns: int, alpha: float, steps: int | None, tol: float, max_iter: int, chunk: int = 15) -> DataFrame:
    """(place, col, p) of p <- (1 - alpha) W p + alpha b from p = b, for all columns in one loop.

    With steps: that many.  Without: a column stops after the first step whose change (sum of absolute differences) is under tol,
    or after max_iter steps, whatever the others do.  One column gives no ``col`` other than 0.
    """

    def taking(todo: np.ndarray) -> Callable[[int, bool], Callable]:
        def step(s: int, send: bool) -> Callable:
            def run(left: pa.Table, right: pa.Table) -> pa.Table:
                head, tiles, n = _split(left)
                b = np.zeros((n, columns))
                if left["rows"][head].is_valid:
                    b[_ints(left["rows"][head]), _ints(left["cols"][head])] = _ints(left["weights"][head], "<f8")
                kinds = right["kind"].to_pylist()
                old = np.frombuffer(right["val"][kinds.index(0)].as_buffer()).reshape(n, columns) if kinds else b
                log = b""
                if s:
                    moved = np.zeros((n, columns))
                    for k, kind in enumerate(kinds):
                        if kind == 1:
                            moved[_ints(right["idx"][k])] += np.frombuffer(right["val"][k].as_buffer()).reshape(-1, columns)
                    x = np.where(s <= todo, (1 - alpha) * moved + alpha * b, old)
                    before = right["log"][kinds.index(0)].as_py() if s > 1 else b""
                    log = before + np.abs(x - old).sum(axis=0).tobytes()
                else:
                    x = old
                block, part = left["block"][0].as_py(), left["part"][0].as_py()
                out = [(block, part, 0, None, x.tobytes(), log)]
                if send:
                    for home, fan, rows, values in _products(left, tiles, x, np.add, True):
                        out += [(home, q, 1, rows.tobytes(), values.tobytes(), None) for q in range(fan)]
                return _table(out)

            return run

        return step

    spark = t.tiles.sparkSession
    state, done, left = spark.createDataFrame([], _STATE), np.zeros(columns, bool), max_iter if steps is None else steps
    ahead = chunk
    while left > 0 and not done.all():
        m = min(chunk, left, ahead)
        todo = np.where(done, 0, m)
        after = _run(t, state, m, taking(todo))
        if steps is None:
            change = _logs(after, (m, columns))
            under = (change < tol) & ~done
            stops = under.any(axis=0)
            at = np.where(stops, under.argmax(axis=0) + 1, m)
            if (at[stops] < m).any():
                after = _run(t, state, m, taking(np.where(done, 0, at)))
            done |= stops
            if not done.all():
                last = float(change[-1, ~done].max())
                ahead = max(1, math.ceil(math.log(tol / last) / math.log(1 - alpha))) if last > tol else 1
        state, left = after, left - m
    if (max_iter if steps is None else steps) <= 0:
        state = _run(t, state, 0, taking(np.zeros(columns, int)))

    size = t.size

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, val in zip(batch["block"].to_pylist(), batch["val"], strict=True):
                x = np.frombuffer(val.as_buffer()).reshape(-1, columns)
                for i in range(0, len(x), max(1, 500_000 // columns)):
                    part = x[i : i + max(1, 500_000 // columns)]
                    place = np.repeat(block * size + np.arange(i, i + len(part), dtype=np.int64), columns)
                    yield pa.record_batch([pa.array(place), pa.array(np.tile(np.arange(columns, dtype=np.int32), len(part))), pa.array(part.ravel())], names=["place", "col", "p"])

    return state.filter("part = 0 and kind = 0").select("block", "val").mapInArrow(unfold, "place long, col int, p double")


def reach(t: Tiled, columns: int, max_depth: int, chunk: int = 4) -> DataFrame:
    """(place, col, dist): the steps from each column's sources (start, b <> 0) to each node, the way the entries go; unreached pairs are left out.

    A node's reached columns are bits, a step joins its neighbours' newly set ones by OR.  Only rows with new bits are sent.
    Depths are kept as 16-bit numbers, so at most 32,766 steps are taken.
    """
    words = -(-columns // 64)
    max_depth = min(max_depth, 32_766)

    def taking(done: int) -> Callable[[int, bool], Callable]:
        def step(s: int, send: bool) -> Callable:
            def run(left: pa.Table, right: pa.Table) -> pa.Table:
                head, tiles, n = _split(left)
                kinds = right["kind"].to_pylist()
                if kinds:
                    both = np.frombuffer(right["val"][kinds.index(0)].as_buffer(), "<u8").reshape(2, n, words).copy()
                    seen, new = both[0], both[1]
                    depth = np.frombuffer(right["idx"][kinds.index(0)].as_buffer(), "<i2").reshape(n, columns).copy()
                else:
                    seen, depth = np.zeros((n, words), "<u8"), np.full((n, columns), -1, "<i2")
                    if left["rows"][head].is_valid:
                        i, c = _ints(left["rows"][head]), _ints(left["cols"][head])
                        np.bitwise_or.at(seen, (i, c // 64), np.uint64(1) << (c % 64).astype("<u8"))
                        depth[i, c] = 0
                    new = seen.copy()
                if s:
                    met = np.zeros((n, words), "<u8")
                    for k, kind in enumerate(kinds):
                        if kind == 1:
                            met[_ints(right["idx"][k])] |= np.frombuffer(right["val"][k].as_buffer(), "<u8").reshape(-1, words)
                    new = met & ~seen
                    seen = seen | new
                    i = np.flatnonzero(new.any(axis=1))
                    bits = np.unpackbits(np.ascontiguousarray(new[i]).view(np.uint8), axis=1, bitorder="little")[:, :columns].astype(bool)
                    rows = depth[i]
                    rows[bits] = done + s
                    depth[i] = rows
                block, part = left["block"][0].as_py(), left["part"][0].as_py()
                out = [(block, part, 0, depth.tobytes(), np.stack((seen, new)).tobytes(), np.array([float(new.any())]).tobytes())]
                if send and new.any():
                    for home, fan, rows, values in _products(left, tiles, new, np.bitwise_or, False):
                        some = values.any(axis=1)
                        if some.any():
                            out += [(home, q, 1, rows[some].tobytes(), values[some].tobytes(), None) for q in range(fan)]
                return _table(out)

            return run

        return step

    state, depth = _run(t, t.tiles.sparkSession.createDataFrame([], _STATE), 0, taking(0)), 0
    while depth < max_depth and _logs(state, (1,))[0] > 0:
        m = min(chunk, max_depth - depth)
        state, depth = _run(t, state, m, taking(depth)), depth + m
    size = t.size

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, idx in zip(batch["block"].to_pylist(), batch["idx"], strict=True):
                d = np.frombuffer(idx.as_buffer(), "<i2").reshape(-1, columns)
                for a in range(0, len(d), max(1, 500_000 // columns)):
                    i, c = np.nonzero(d[a : a + max(1, 500_000 // columns)] >= 0)
                    yield pa.record_batch([pa.array(block * size + a + i), pa.array(c.astype(np.int32)), pa.array(d[a + i, c].astype(np.int32))], names=["place", "col", "dist"])

    return state.filter("part = 0 and kind = 0").select("block", "idx").mapInArrow(unfold, "place long, col int, dist int")
