"""Substring dedup by content-defined chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import Work, batched, fresh, kept, map_arrow, table

_GEAR = np.random.Generator(np.random.PCG64(4242)).integers(0, 2**32, 256, dtype=np.uint32)
#: The start of a word may be a cut; of every WINDOW such in a row, the one of the least gear hash is (the last of equal ones).
#: The hash's low bits count, which the SPAN bytes before decide: each cut depends on the text near it, on no other cut.
WINDOW, SPAN = 8, 12
_LOW = np.uint32((1 << SPAN) - 1)
#: LONG bytes into a word, a cut follows a byte where these bits are 0 (once in 32 bytes, decided by the 21 bytes before it) and APART bytes before they weren't.
_MASK = np.uint32(0x001F0000)
LONG, APART, MOST = 64, 8, 160
#: Words that 51 shared words of any length hold for certain between cuts of their own: those of the words 13 to 43, the first by the 20th, the last from the 36th on.
SURE_WORDS = 16
#: So by the 20th of 51 shared words a chunk starts in every copy, with this many shared words from there on.
REPEAT_WORDS = 31
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def gear(data: np.ndarray) -> np.ndarray:
    """The gear rolling hash h = 2 h + G[byte] at every byte: 32 bits, so the last 32 bytes decide.  Doubling spans, no loop over bytes."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            longer = h.copy()
            longer[shift:] += h[:-shift] << np.uint32(shift)
            h = longer
    return h


def word_starts(data: np.ndarray) -> np.ndarray:
    """Places of bytes after a blank that are none."""
    blank = _BLANK[data]
    return np.flatnonzero(blank[:-1] & ~blank[1:]) + 1


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes of the buffer) of every row's chunks, and their rows.

    A chunk has WINDOW words and MOST bytes at most and never parts a character.  Words are windowed
    within their row and from its SPAN-th byte on, so a row's cuts don't depend on the row before it.
    """
    whole, h = np.append((data & 0xC0) != 0x80, True), gear(data)
    words = word_starts(data)
    row = np.searchsorted(offs, words, "right") - 1
    inside = words - offs[row] >= SPAN
    at, row = words[inside], row[inside]
    picked = at[:0]
    if len(at) >= WINDOW:
        least = ((h[at - 1] & _LOW).astype(np.int64) << 32) - np.arange(len(at))
        for shift in (1, 2, 4):
            least = np.minimum(least[:-shift], least[shift:])
        picked = at[np.unique(-least[row[: len(least)] == row[WINDOW - 1 :]] & 0xFFFFFFFF)]
    spots = np.flatnonzero(((h & _MASK) == 0) & whole[1:]) + 1
    spots = spots[(np.diff(spots, prepend=-APART - 1) > APART) & (spots < len(data))]
    marks = np.union1d(words, offs)
    spots = spots[spots - marks[np.searchsorted(marks, spots, "right") - 1] >= LONG]
    cuts = np.unique(np.concatenate([offs, picked, spots]))
    more = []
    for k in np.flatnonzero(np.diff(cuts) > MOST).tolist():
        stop = int(cuts[k])
        while cuts[k + 1] - stop > MOST:
            stop += MOST
            while not whole[stop]:
                stop -= 1
            more.append(stop)
    cuts = np.union1d(cuts, np.array(more, np.int64)).astype(np.int64)
    return cuts[:-1], cuts[1:], np.searchsorted(offs, cuts[:-1], "right") - 1


def reach(data: np.ndarray, offs: np.ndarray, chunks: tuple[np.ndarray, np.ndarray, np.ndarray], min_words: int, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For every chunk the end (byte) of the min_words words from its start on, and the last chunk that ends within them.

    Where those words have over 3 * min_bytes bytes (there are words without end, as in text without blanks) or the
    row has fewer, it is the end of the chunks that make min_bytes bytes.  -1 where the row ends before that.
    """
    starts, ends, rows = chunks
    if not len(starts):
        return starts, starts
    begin, stop, of = K.runs_of(~_BLANK[data], offs)
    word = np.searchsorted(begin, starts) + min_words - 1
    at = np.minimum(word, max(len(begin) - 1, 0))
    enough = (word < len(begin)) & (of[at] == rows) if len(begin) else np.zeros(len(starts), bool)
    stop = np.where(enough, stop[at] if len(begin) else -1, -1)
    far = ~enough | (stop - starts > 3 * min_bytes)
    last = np.minimum(np.searchsorted(ends, starts + min_bytes), len(ends) - 1)
    by_bytes = np.where((rows[last] == rows) & (ends[last] - starts >= min_bytes), ends[last], -1)
    stop = np.where(far, by_bytes, stop)
    return stop, np.searchsorted(ends, stop, "right") - 1


_CHUNKS = "hi long, lo long, doc long, place long, id long"


def chunk_rows(docs: DataFrame, min_words: int, min_bytes: int) -> DataFrame:
    """docs (doc, doc2, id, text) as chunks: a 128-bit digest of a chunk and what follows it (reach), the document, and doc2 and the chunk's number as one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        for i, _, data, offs in K.chunks(batch["text"]):
            starts, _, rows = chunks = cut(data, offs)
            stops, _ = reach(data, offs, chunks, min_words, min_bytes)
            at = np.flatnonzero(stops >= 0)
            number = at - np.searchsorted(rows, rows[at])
            for column, x in zip(out, (*K.digests(data, starts[at], stops[at]), rows[at] + i, number), strict=True):
                column.append(x)
        hi, lo, rows, number = (np.concatenate(c) for c in out)
        at, place = pa.array(rows), (batch["doc2"].to_numpy().astype(np.int64)[rows] << 32) | number
        return pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), batch["doc"].take(at), pa.array(place), batch["id"].take(at)], names=["hi", "lo", "doc", "place", "id"])

    return map_arrow(docs, run, _CHUNKS)


def _lists(values: pa.Array, rows: np.ndarray, n: int) -> pa.ListArray:
    """Values of ascending rows as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def drop_repeats(docs: DataFrame, min_bytes: int = 400, id_col: str = "doc_id", text_col: str = "text", min_words: int = REPEAT_WORDS) -> DataFrame:
    """docs with kept_text and what repeats: n_chunks, n_shared, n_dropped, dropped_bytes, dropped (spans of bytes) and owners.

    Texts are cut where a gear rolling hash of the bytes says so, so an insertion moves no cut far from
    it.  A chunk has one digest with the chunks and words after it that make min_words words (reach); if documents of
    two ids have it, its chunks repeat in both.  The document of the smallest id keeps them, the others
    lose theirs.  A passage of more than 50 words always has such a digest in every copy; its ends, up to 20 words
    before and 15 after, may stay, and nothing of fewer than min_words words (or min_bytes bytes) counts as a repeat.
    n_shared counts a document's chunks that repeat, owners lists the ids that keep what it lost.

    Digests and places are shuffled twice by the same plan at any size, texts once, to their spans.  Null and empty
    texts have no chunks.  Rows without id are told apart by their text; repeated rows (id and text) are one
    document and get equal results; an empty table gives an empty result.  Columns of the names added
    are replaced; other columns may have any name.
    """
    spark = docs.sparkSession
    batched(spark)
    work = Work(spark, "chunks")
    added = {"kept_text", "n_chunks", "n_shared", "n_dropped", "dropped_bytes", "dropped", "owners"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    id_, text = F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit(""))
    ids, own_id = [F.xxhash64(id_, text), F.hash(id_, text)], F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text))
    rows = docs.select(ids[0].alias("doc"), ids[1].alias("doc2"), own_id.alias("id"), text.alias("text"))
    chunks = chunk_rows(rows, min_words, min_bytes)
    shared = chunks.groupBy("hi", "lo").agg(F.min("id").alias("owner"), F.max("id").alias("other")).filter("owner < other").select("hi", "lo", "owner")
    shared = work.stage(shared, "shared")
    hits = chunks.drop("id").join(shared.hint("merge"), ["hi", "lo"]).select("doc", F.shiftright("place", 32).cast("int").alias("doc2"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("idx"), "owner")
    spans = hits.groupBy("doc", "doc2").agg(F.sort_array(F.collect_set(F.struct("idx", "owner"))).alias("spans"))
    spans = work.stage(spans, "spans")
    work.drop("shared")
    d, d2, s, own = (fresh(docs, c) for c in ("_doc", "_doc2", "_spans", "_own"))
    joined = docs.withColumns({d: ids[0], d2: ids[1], own: own_id}).join(spans.withColumnsRenamed({"doc": d, "doc2": d2, "spans": s}), [d, d2], "left").select(*kept(docs), text.alias(d), s, own)
    n_docs = len(docs.columns)
    extra = [
        T.StructField("kept_text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_chunks", "n_shared", "n_dropped", "dropped_bytes")),
        T.StructField("dropped", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("owners", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[pa.Array]] = [[] for _ in extra]
        texts, spans, me = (batch.column(n_docs + k) for k in range(3))
        for i, j, data, offs in K.chunks(texts):
            n = j - i
            starts, ends, of = chunks = cut(data, offs)
            (_, last), first = reach(data, offs, chunks, min_words, min_bytes), np.searchsorted(of, np.arange(n))
            part = spans.slice(i, n)
            counts = part.value_lengths().fill_null(0).to_numpy()
            found, row = part.flatten(), np.repeat(np.arange(n), counts)
            chunk, owner = first[row] + found.field(0).to_numpy(), found.field(1).to_numpy()
            lost = owner != me.slice(i, n).to_numpy()[row]
            repeats, gone = _covered(chunk, last, len(starts)), _covered(chunk[lost], last, len(starts))
            a, b, k = K.runs_of(gone, np.concatenate((first, [len(starts)])))
            begin, end = starts[a], ends[b - 1]
            byte = np.zeros(len(data) + 1, np.int32)
            byte[begin] += 1
            np.subtract.at(byte, end, 1)
            stay = np.cumsum(byte[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(stay)))[offs]
            text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[stay].tobytes())])
            per = lambda flags, n=n, of=of: pa.array(np.bincount(of[flags], minlength=n))
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(k) + 1, 2, dtype=np.int32)), pa.array(np.column_stack([begin - offs[k], end - offs[k]]).ravel()))
            who = np.unique(np.column_stack([row[lost], owner[lost]]), axis=0)
            new = (text.cast(pa.string()), per(slice(None)), per(repeats), per(gone), pa.array(np.diff(offs) - np.diff(left)), _lists(pairs, k, n), _lists(pa.array(who[:, 1]), who[:, 0], n))
            for column, v in zip(out, new, strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_docs)), *(pa.concat_arrays(c) for c in out)], names=schema.names)

    return map_arrow(joined.toDF(*(f"c{k}" for k in range(n_docs + 3))), run, schema)


def _covered(chunk: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n chunks lie between one of those given and its last."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, chunk, 1)
    np.subtract.at(edge, last[chunk] + 1, 1)
    return np.cumsum(edge[:-1]) > 0


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of documents: what each keeps, and whose copies it lost."""
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chunks", "n_shared", "n_dropped", "dropped_bytes", "owners", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
