"""Byte-level numpy kernels shared by the corpus operators.

A batch of texts is one uint8 buffer plus offsets (Arrow's own layout, so nothing is copied).
Words, their 64-bit hashes and word-window hashes come out of whole-buffer array operations;
no Python code runs per word.  Batches are cut to ``CHUNK`` bytes, so memory is bounded by
the larger of that and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_MULT, _MULT2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
#: Per-position multipliers of the window hash.
_POS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_TABLE2 = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)

#: Words ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int, m: int = _MULT) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, modulo 2**64."""
    if len(_powers.get(m, ((),))[0]) < n:
        size, made = max(n, CHUNK + 1), []
        for x in (m, pow(m, -1, 2**64)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[m] = tuple(made)
    return _powers[m][0][:n], _powers[m][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets from 0; a null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with at most limit bytes, one row at least."""
    data, offs = buffers(texts)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs_of(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of set flags; runs end with their row."""
    n = len(flags)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0], before[1:] = False, flags[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, flags[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(flags & ~before)
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z as a-z if fold."""
    return _spans(data, starts, ends, _TABLE[FOLD] if fold else _TABLE, _MULT)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, m: int) -> np.ndarray:
    p, q = _pow(len(data) + 1, m)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each span of bytes, as two halves: sums over unlike tables and multipliers."""
    return _spans(data, starts, ends, _TABLE, _MULT), _spans(data, starts, ends, _TABLE2, _MULT2)


class Words:
    """Words of a chunk: starts and ends (bytes), row, 64-bit hash; first is each row's first word, counts their number."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACE_WORDS, fold: bool = True):
        self.starts, self.ends, self.rows = runs_of(is_word[data], offs)
        self.hashes = span_hashes(data, self.starts, self.ends, fold)
        self.counts = np.bincount(self.rows, minlength=len(offs) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of that many words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _POS[0]
    for k in range(1, width):
        out += hashes[k : k + n] * _POS[k]
    return mix(out + np.uint64(width))


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes; fewer words than width form one shingle, none give none."""
    all_windows = windows(words.hashes, width)
    for a, n in zip(words.first.tolist(), words.counts.tolist(), strict=False):
        if n >= width:
            yield np.unique(all_windows[a : a + n - width + 1])
        elif n:
            yield windows(words.hashes[a : a + n], n)
        else:
            yield np.zeros(0, np.uint64)
