"""Ranked lexical search: an inverted index in segments, searched document at a time."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import LOWER, UPPER, Work, batched, parts_of, small, table

#: Bytes of text in a segment, and items searched together.
SEGMENT_BYTES = 16 << 20
BLOCK = 256
#: Terms are runs of ASCII letters, digits and all bytes from 0x80 on.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NONE = (1 << 63) - 1


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative integers, seven bits each and the highest set where more follow; and where each one's bytes end."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        low = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[(ends - size)[some] + k] = low | ((size[some] > k + 1).astype(np.uint8) << np.uint8(7))
    return out, ends


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & np.uint8(127)).astype(np.int64) << shift, starts)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every term of the texts."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, _, data, offs in K.chunks(texts):
        words = K.Words(data, offs, TERM)
        rows.append(words.rows + i), hashes.append(words.hashes)
    return np.concatenate(rows), np.concatenate(hashes)


_INDEX = pa.schema([("seg", pa.int64()), ("tid", pa.int64()), ("df", pa.int64()), ("total", pa.int64()), ("data", pa.binary()), ("ids", pa.binary())])
_INDEX_SQL = "seg long, tid long, df long, total long, data binary, ids binary"


def _segment(seg: int, ids: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for the documents that have terms, in order of id, and one a term: gaps of document numbers, then counts."""
    lengths = np.bincount(rows, minlength=len(ids))
    order = np.argsort(ids, kind="stable")
    order = order[lengths[order] > 0]
    number = np.zeros(len(ids), np.int64)
    number[order] = np.arange(len(order))
    at = np.lexsort((number[rows], hashes))
    h, d = hashes[at], number[rows][at]
    if not len(h):
        return
    new_term = np.concatenate(([True], h[1:] != h[:-1]))
    new = np.flatnonzero(new_term | np.concatenate(([True], d[1:] != d[:-1])))
    tf, d, new_term = np.diff(np.append(new, len(h))), d[new], new_term[new]
    tids = h[new][new_term].view(np.int64)
    first = np.flatnonzero(new_term)
    df = np.diff(np.append(first, len(d)))
    gaps = np.diff(d, prepend=0)
    gaps[first] = d[first]
    place = np.arange(len(d)) + np.repeat(first, df)
    values = np.empty(2 * len(d), np.int64)
    values[place], values[place + np.repeat(df, df)] = gaps, tf
    data, ends = varints(values)
    cuts = ends[2 * (first + df) - 1]
    head, _ = varints(lengths[order])
    yield pa.record_batch([pa.array([seg]), pa.array([None], pa.int64()), pa.array([len(order)]), pa.array([int(lengths.sum())]), pa.array([head.tobytes()], pa.binary()), pa.array([ids[order].tobytes()], pa.binary())], schema=_INDEX)
    totals = np.add.reduceat(tf, first)
    for i in range(0, len(df), 50_000):
        j = min(i + 50_000, len(df))
        begin = cuts[i - 1] if i else 0
        offs = np.concatenate(([begin], cuts[i:j])) - begin
        blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data[begin : cuts[j - 1]].tobytes())])
        yield pa.record_batch([pa.array(np.full(j - i, seg)), pa.array(tids[i:j]), pa.array(df[i:j]), pa.array(totals[i:j]), blobs, pa.nulls(j - i, pa.binary())], schema=_INDEX)


def _best(lists: list[tuple[int, list[int], list[int]]], heap: list[tuple[int, int]], k: int, ids: list[int]) -> None:
    """Puts the best documents of a segment into the heap of (score, -id), k at most.

    lists: (greatest share of a score, document numbers ascending, shares).  Documents are taken in order of number by a heap
    over the lists.  Once the result heap is full, the lists of least shares whose sum stays below its worst score can't
    bring in a document by themselves: they leave the merge and are searched for the documents that the others bring, the
    greatest first, and only while the score can still be reached.  No document is lost by that; equal scores are always tried.
    """
    lists = sorted(lists, key=lambda x: x[0])
    sums = list(accumulate((x[0] for x in lists), initial=0))
    numbers, shares, at = [x[1] for x in lists], [x[2] for x in lists], [0] * len(lists)
    worst = heap[0][0] if len(heap) == k else 1
    free = 0  # lists before it are searched, not merged
    while free < len(lists) and sums[free + 1] < worst:
        free += 1
    merge = [(numbers[j][0], j) for j in range(free, len(lists))]
    heapq.heapify(merge)
    replace, pop = heapq.heapreplace, heapq.heappop
    while merge:
        doc, score = merge[0][0], 0
        while merge and merge[0][0] == doc:
            j = merge[0][1]
            i = at[j]
            score += shares[j][i]
            at[j] = i = i + 1
            if i < len(numbers[j]):
                replace(merge, (numbers[j][i], j))
            else:
                pop(merge)
        for j in range(free - 1, -1, -1):
            if score + sums[j + 1] < worst:
                break
            i = at[j] = bisect_left(numbers[j], doc, at[j])
            if i < len(numbers[j]) and numbers[j][i] == doc:
                score += shares[j][i]
        if score < worst:
            continue
        entry = (score, -ids[doc])
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == k and heap[0][0] > worst:
            worst = heap[0][0]
            was = free
            while free < len(lists) and sums[free + 1] < worst:
                free += 1
            if free > was:
                merge = [x for x in merge if x[1] >= free]
                heapq.heapify(merge)


class RankedIndex:
    """Compressed postings of all terms of docs, in segments of about ``segment_bytes`` of text, written once to the shared folder.

    A segment holds some rows of one partition: its documents numbered by id, and for each term their numbers as gaps
    and the counts as variable-length integers.  Building shuffles nothing, and a task holds one segment
    (or one text, if that is longer).  Terms are 64-bit hashes.

    Nulls and texts without a term are no documents; a null id ranks behind all others; rows of equal id are documents of
    their own; an empty table gives an empty index; texts of any length are taken whole.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES):
        self.spark = docs.sparkSession
        batched(self.spark)
        work = Work(self.spark, "search")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, n = TaskContext.get().partitionId(), 0
            ids, rows, hashes, size, count = [], [], [], 0, 0
            for batch in batches:
                for i in range(0, batch.num_rows, 100):
                    part = batch.slice(i, 100)
                    r, h = _terms(part["text"])
                    ids.append(part["id"].fill_null(_NONE).to_numpy(zero_copy_only=False)), rows.append(r + count), hashes.append(h)
                    count += part.num_rows
                    size += int(K.buffers(part["text"])[1][-1])
                    if size >= segment_bytes:
                        yield from _segment(task << 32 | n, np.concatenate(ids), np.concatenate(rows), np.concatenate(hashes))
                        ids, rows, hashes, size, count, n = [], [], [], 0, 0, n + 1
            if count:
                yield from _segment(task << 32 | n, np.concatenate(ids), np.concatenate(rows), np.concatenate(hashes))

        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        self.table = work.stage(rows.mapInArrow(run, _INDEX_SQL), "index")

    def counts(self) -> tuple[int, int]:
        """Documents with terms, and all their terms."""
        n, total = self.table.filter("tid is null").agg(F.sum("df"), F.sum("total")).first()
        return n or 0, total or 0

    def search(self, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
        """(item, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending id.

        items: rows of an id (null counts as one) and a text; an item's terms are those of all its rows, once each.
        A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its share of a score weight * (10^9 tf div (1000 tf + 8 m))
        with m = 10 + 90 n N div L.

        Items are dealt into blocks of about ``block``; a block's postings of one segment go to one task, which decodes each
        list once for the whole block and merges the lists of each item (``_best``).  A task's segments share an item's result heap.  Each task gives
        k documents an item at most; the best of those are the answer.
        """
        spark, work = self.spark, Work(self.spark, "query")
        docs, total = self.counts()

        def asked(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, hashes = _terms(batch["text"])
            return pa.record_batch({"item": batch["item"].take(pa.array(rows)), "tid": pa.array(hashes.view(np.int64))})

        named = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
        kind = named.schema["item"].dataType.simpleString()
        found = named.mapInArrow(lambda batches: (asked(b) for b in batches if b.num_rows), f"item {kind}, tid long")
        found = work.stage(found.distinct(), "asked")
        distinct = found.select("item").distinct()
        blocks = max(1, -(-distinct.count() // block))
        dealt = distinct.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
        slots = work.stage(dealt.withColumn("slot", (F.row_number().over(Window.partitionBy("block").orderBy("item")) - 1).cast("int")), "slots")
        terms = self.table.filter("tid is not null")
        frequency = terms.select("tid", "df").join(small(found.select("tid").distinct()), "tid", "left_semi").groupBy("tid").agg(F.sum("df").alias("all"))
        weight = F.floor(1000 * F.log((2 * F.lit(docs) + 2) / (2 * F.col("all") + 1)))
        weighed = work.stage(frequency.select("tid", weight.cast("long").alias("w")).filter("w > 0"), "weights")
        users = found.join(small(slots), found["item"].eqNullSafe(slots["item"])).select("block", "slot", "tid").join(small(weighed), "tid")
        users = work.stage(users.groupBy("block", "tid", "w").agg(F.collect_list("slot").alias("slots")), "users")
        lists = terms.join(small(users), "tid").select("block", "seg", "tid", "w", "slots", "df", "data", "ids")
        heads = self.table.filter("tid is null").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "seg", "tid", F.lit(0).cast("long").alias("w"), F.array().cast("array<int>").alias("slots"), "df", "data", "ids")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heaps: dict[int, list[tuple[int, int]]] = {}
            now, ids, m, held = (None, None), [], None, {}

            def close() -> None:
                for slot, lists in held.items():
                    _best(lists, heaps.setdefault(slot, []), k, ids)
                held.clear()

            def result() -> pa.RecordBatch:
                rows = [(now[0], slot, -d, score) for slot, heap in heaps.items() for score, d in heap]
                heaps.clear()
                block, slot, doc, score = zip(*rows, strict=True) if rows else ((), (), (), ())
                return pa.record_batch([pa.array(block, pa.int32()), pa.array(slot, pa.int32()), pa.array([None if d == _NONE else d for d in doc], pa.int64()), pa.array(score, pa.int64())], names=["block", "slot", "doc_id", "score"])

            for batch in batches:
                for at, row in enumerate(zip(batch["block"].to_pylist(), batch["seg"].to_pylist(), batch["tid"].is_null().to_pylist(), batch["w"].to_pylist(), batch["slots"].to_pylist(), batch["df"].to_pylist(), strict=True)):
                    b, seg, head, w, slots, df = row
                    if (b, seg) != now:
                        close()
                        if b != now[0] and heaps:
                            yield result()
                        now = (b, seg)
                    values = unvarints(batch["data"][at].as_py())
                    if head:
                        ids = np.frombuffer(batch["ids"][at].as_py(), np.int64).tolist()
                        m = 10 + 90 * values * docs // total
                        continue
                    numbers, tf = np.cumsum(values[:df]), values[df:]
                    share = w * (1_000_000_000 * tf // (1000 * tf + 8 * m[numbers]))
                    some = (int(share.max()), numbers.tolist(), share.tolist())
                    for slot in slots:
                        held.setdefault(slot, []).append(some)
            close()
            if heaps:
                yield result()

        dealt = lists.unionAll(heads).repartition(parts_of(spark), "block", "seg").sortWithinPartitions("block", "seg", F.col("tid").isNotNull())
        best = dealt.mapInArrow(run, "block int, slot int, doc_id long, score long")
        order = Window.partitionBy("block", "slot").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.join(small(slots), ["block", "slot"]).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    index = RankedIndex(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.search(table(spark, sf_dir, "benchmark").select("item_id", "text")).withColumnRenamed("item", "item_id")


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS w FROM documents),
 lengths AS (SELECT rn, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
 whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
 q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
 tf AS (SELECT rn, t, count(*) AS tf FROM (SELECT rn, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
 weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY 1), whole),
 scored AS (SELECT q.item_id, l.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + ((90 * l.n * docs) // total))))) AS BIGINT) AS score
   FROM q JOIN weights w USING (t) JOIN tf USING (t) JOIN lengths l USING (rn), whole GROUP BY q.item_id, l.rn, l.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
