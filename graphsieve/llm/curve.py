"""Packing of token sequences along a space-filling curve through hashed document vectors."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Work, batched, small, table

CAPACITY = 1024
#: Dimensions of the curve and bits of each; buckets of a hashed document vector.
DIMS, BITS, BUCKETS = 4, 15, 4096
#: A piece of text that is one word of ASCII letters, which goes to the vocabulary's merges as it is; or any without white space but a space before it.
_WORD = re.compile(" ?[A-Za-z]+")
_SIMPLE = re.compile("(?: ?[!-~À-ȿ]+)")
_MARKS = np.zeros(256, bool)
_MARKS[[*b',.;:!?")']] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_000_000


class Encoder:
    """Token ids of many texts by a tokenizer file, each distinct piece of text encoded once while it is remembered.

    A byte-level vocabulary splits text before it merges.  It never joins what stands on both sides of a cut before a
    single space, or before and after a single line feed, if the characters around are visible ones of ASCII or U+00C0 to
    U+023F; nor a letter of these and a mark of _MARKS after it.  So the ids of a text are the ids of its pieces between such cuts.  New pieces are encoded as words
    or as lines of one text.  Pieces are known by 128-bit digests.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.line_feed = self._ids(["\n"])[0].tolist()
        self.space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]
        self.forget()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.flat, self.starts, self.sizes, self.second = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def _learn(self, pieces: list[str], first: list[int], second: np.ndarray) -> None:
        words, lines, rest = [], [], []
        for k, p in enumerate(pieces):
            (words if _WORD.fullmatch(p) else lines if len(self.line_feed) == 1 and _SIMPLE.fullmatch(p) else rest).append(k)
        flat, sizes, tokenize = [], np.zeros(len(pieces), np.int64), self.tokenizer.model.tokenize
        spelled = [[t.id for t in tokenize(pieces[k].replace(" ", self.space))] for k in words]
        sizes[words] = [len(x) for x in spelled]
        flat.append(np.fromiter(chain.from_iterable(spelled), self.kind))
        for i in range(0, len(lines), 200):
            ids = self._ids(["\n".join(pieces[k] for k in lines[i : i + 200])])[0]
            feeds = np.flatnonzero(ids == self.line_feed[0])
            sizes[lines[i : i + 200]] = np.diff(np.concatenate(([-1], feeds, [len(ids)]))) - 1
            flat.append(np.delete(ids, feeds))
        for i in range(0, len(rest), 200):
            got = self._ids([pieces[k] for k in rest[i : i + 200]])
            sizes[rest[i : i + 200]] = [len(x) for x in got]
            flat += got
        order, n, used = np.array(words + lines + rest, np.int64), len(self.sizes), len(self.flat)
        starts = np.empty(len(pieces), np.int64)
        starts[order] = used + np.cumsum(sizes[order]) - sizes[order]
        self.flat, self.starts = np.concatenate((self.flat, *flat)), np.concatenate((self.starts, starts))
        self.sizes, self.second = np.concatenate((self.sizes, sizes)), np.concatenate((self.second, second))
        self.number.update(zip(first, range(n, n + len(pieces)), strict=True))

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        visible, lead = (data > 0x20) & (data < 0x7F), (data >= 0xC3) & (data <= 0xC8)
        ends, letters = visible.copy(), _LETTER[data]
        tail = (data[1:] >= 0x80) & (data[1:] < 0xC0) & lead[:-1]
        ends[1:] |= tail
        letters[1:] |= tail & ((data[:-1] != 0xC3) | ((data[1:] & 0xDF) != 0x97))  # U+00D7 and U+00F7 are signs
        begins = visible | lead
        single = np.zeros(len(data), bool)
        single[1:-1] = ends[:-2] & begins[2:]
        cut = single & ((data == 0x20) | (data == 0x0A))
        cut[1:] |= (single & (data == 0x0A))[:-1] | (letters[:-1] & _MARKS[data[1:]])
        cut[offs[:-1][np.diff(offs) > 0]] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts one after another, and the number of each text's."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offs) - 1, np.int64)
        starts = self._cuts(data, offs)
        ends = np.append(starts[1:], len(data))
        first, second = K.digests(data, starts, ends)
        distinct, where, of = np.unique(first, return_index=True, return_inverse=True)
        if len(self.number) + len(distinct) > REMEMBERED:
            self.forget()
        names = distinct.tolist()
        at = np.array([self.number.get(x, -1) for x in names])
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            at[new] = len(self.sizes) + np.arange(len(new))
            self._learn([raw[starts[k] : ends[k]].decode() for k in where[new].tolist()], [names[k] for k in new.tolist()], second[where[new]])
        at = at[of]
        if (self.second[at] != second).any():  # two pieces of one digest: each text by itself
            got = self._ids([data[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)])
            return np.concatenate(got), np.array([len(x) for x in got])
        sizes = self.sizes[at]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.starts[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, offs)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vectors(ids: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Each text's hashed vector (log of 1 + count in BUCKETS buckets, of length one), projected to DIMS dimensions."""
    project = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    bucket = (K.mix(ids.astype(np.uint64) + np.uint64(seed)) % np.uint64(BUCKETS)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.log1p(np.bincount(row * BUCKETS + bucket, minlength=len(sizes) * BUCKETS).reshape(len(sizes), BUCKETS).astype(np.float32))
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    return (counts / np.maximum(norm, 1e-9)) @ project


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (integers of that many bits) on the Hilbert curve of their dimensions."""
    x = cells.T.astype(np.int64).copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of every level, from the highest
        for i in range(dims):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros(len(cells), np.int64), top
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(row, doc_id, n, ids, x0...): ids of the text and end_id as little-endian bytes, n their number, x the projected vector."""
    batched(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            for i, j, data, offs in K.chunks(batch["text"]):
                part = batch.slice(i, j - i)
                ids, sizes = known.encode(data, offs)
                x = vectors(ids, sizes, seed)
                ends = np.cumsum(sizes + 1)
                whole = np.full(int(ends[-1]), end_id, known.kind)
                keep = np.ones(len(whole), bool)
                keep[ends - 1] = False
                whole[keep] = ids
                width = whole.itemsize
                blobs = [whole[a:b].tobytes() for a, b in zip(ends - sizes - 1, ends, strict=True)]
                yield pa.record_batch([part["row"], part["doc_id"], pa.array(sizes + 1), pa.array(np.full(len(sizes), width, np.int32)), pa.array(blobs, pa.binary()), *(pa.array(x[:, d].astype(np.float64)) for d in range(DIMS))], names=["row", "doc_id", "n", "width", "ids", *(f"x{d}" for d in range(DIMS))])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, width int, ids binary, " + ", ".join(f"x{d} double" for d in range(DIMS)))


def along_curve(points: DataFrame) -> DataFrame:
    """(row, key) of points (row, x0...): each dimension by its mean and deviation over all rows to BITS bits, then the Hilbert key."""
    spread = points.agg(*[f(f"x{d}") for d in range(DIMS) for f in (F.avg, F.stddev_pop)]).first()
    mean, deviation = np.array([x or 0.0 for x in spread[::2]]), np.array([x or 1.0 for x in spread[1::2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch[f"x{d}"].to_numpy() for d in range(DIMS)], axis=1)
            share = 1 / (1 + np.exp(-1.7 * np.clip((x - mean) / deviation, -20, 20)))
            cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.record_batch([batch["row"], batch["doc_id"], batch["n"], pa.array(hilbert(cells, BITS))], names=["row", "doc_id", "n", "key"])

    return points.select("row", "doc_id", "n", *(f"x{d}" for d in range(DIMS))).mapInArrow(run, "row long, doc_id long, n long, key long")


def pack_along_curve(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of all documents in sequences of ``capacity`` tokens.

    Texts become ids by the tokenizer file at path (byte_bpe_50k.json), each followed by end_id.  Documents are ordered by
    the Hilbert key of their hashed vector, then by id and row, and laid end to end: a sequence is the next ``capacity`` ids, so
    it holds neighbours on the curve, only the last one is not full, and a document is cut where a sequence ends.

    Ids are written once.  Only (row, id, length, key) is sorted by range; a place is the sum of lengths before it in its range and
    of the ranges before, a row a range.  Equal texts have one key; as rows break ties, however many copies there are, ranges
    split among them.  ids: little-endian, two bytes each for vocabularies up to 65,536, else four.

    A null or empty text is end_id alone; a null id is kept; repeated rows are documents of their own; texts of any length are
    taken whole (a text's ids are held at once); an empty table gives no pieces.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    work = Work(docs.sparkSession, "curve")
    tokens = work.stage(tokenised(docs, path, end_id, id_col, text_col, seed), "tokens")
    keyed = work.stage(along_curve(tokens), "keyed")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch["n"].to_numpy()
            ends = total + np.cumsum(n)
            yield pa.record_batch([batch["row"], pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(n)], names=["row", "part", "at", "n"])
            total = int(ends[-1]) if len(ends) else total

    order = ["key", "doc_id", "row"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, "row long, part long, at long, n long")
    ordered = work.stage(ordered, "ordered")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ordered.groupBy("part").agg(F.sum("n").alias("n")).select("part", before.alias("before"))
    work.drop("keyed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, place, width, blob in zip(batch["doc_id"].to_pylist(), batch["place"].to_pylist(), batch["width"].to_pylist(), batch["ids"], strict=True):
                ids = np.frombuffer(blob.as_buffer(), np.dtype(f"<u{width}"))
                a = 0
                while a < len(ids):
                    b = min(len(ids), a + capacity - (place + a) % capacity)
                    piece = ids[a:b]
                    out.append((doc, a, b - a, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), (place + a) // capacity, (place + a) % capacity, *([piece.tobytes()] if with_ids else [])))
                    a = b
            columns = list(zip(*out, strict=True)) if out else [()] * (8 if with_ids else 7)
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    placed = tokens.select("row", "doc_id", "width", "ids").join(small(ordered.select("row", "part", "at")), "row").join(F.broadcast(ranges), "part")
    return placed.select("doc_id", (F.col("at") + F.col("before")).alias("place"), "width", "ids").mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as byte-pair ids in sequences of 1,024 along the curve."""
    return pack_along_curve(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
