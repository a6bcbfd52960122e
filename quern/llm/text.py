"""Vectorised word and chunk splitting over Arrow batches.

Everything here works on the UTF-8 bytes of a slice of rows: look-up tables mark
separators, boundaries come from ``flatnonzero``, and Arrow's dictionary encoding
gives each distinct word of a slice once.  Null texts count as empty ones.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once by a worker; bounds its memory whatever the batch is.
SLICE_BYTES = 4 << 20


def table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of ``[^\x20\x09-\x0D]``.
SPACE_WORD = ~table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: lower-case ASCII letters, digits, all beyond ASCII.
ALNUM_WORD = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


#: The same for operators that hold many numbers a word.
SMALL_SLICE = 2 << 20


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give freed memory back: workers live on, and what one step needed would add to the next."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


#: What a worker keeps from task to task, and what of it the task at hand has asked for.
_held: dict[tuple, object] = {}
_asked: set[tuple] = set()


def held(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, kept in this worker until a task that reads texts has not asked for it."""
    _asked.add(key)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what was kept for other operators: workers outlive them, and a tokenizer's memory would add to every later step."""
    if drop := _held.keys() - _asked:
        for key in drop:
            del _held[key]
        gc.collect()
        trim()
    _asked.clear()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of at most ``limit`` text bytes (a longer row stands alone)."""
    let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
        del batch
        trim()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string()) if column.null_count or not pa.types.is_large_string(column.type) else column
    n, start = len(column), column.offset
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64, count=start + n + 1)[start:] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Words:
    ids: np.ndarray  # of each word, its place in the slice's dictionary
    dictionary: pa.BinaryArray
    counts: np.ndarray  # words of each row
    starts: np.ndarray  # byte place of each word

    @property
    def row_start(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit xxh3 of each dictionary entry."""
        return word_hashes(self.dictionary)


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(words))


def encode_runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Dictionary-encode byte runs that fill ``raw`` without gaps."""
    offs = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offs[1:])
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(raw))])
    enc = arr.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False), enc.dictionary


def split_words(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACE_WORD, lower: bool = True) -> Words:
    """Words of each row: maximal runs of ``is_word`` bytes, ASCII letters lowered first if asked."""
    n = len(offs) - 1
    if lower:
        raw = LOWER[raw]
    if not len(raw):
        return Words(np.zeros(0, np.int32), pa.array([], pa.large_binary()), np.zeros(n, np.int64), np.zeros(0, np.int64))
    w = is_word[raw]
    prev = np.empty_like(w)
    prev[0] = False
    prev[1:] = w[:-1]
    some = offs[1:] > offs[:-1]
    prev[offs[:-1][some]] = False
    starts = np.flatnonzero(w & ~prev)
    prev[:-1] = w[1:]
    prev[-1] = False
    prev[offs[1:][some] - 1] = False
    ends = np.flatnonzero(w & ~prev) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    ids, dictionary = encode_runs(raw[w], starts, ends - starts)
    return Words(ids, dictionary, counts, starts)


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (bytes, flags) between successive offsets; empty rows give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every ``size``-word shingle, shingles of each row).

    A row of fewer words, but not none, has its whole sequence as one shingle;
    the length takes part in the hash, so it never equals a full shingle.
    """
    n_sh = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    total, n = int(n_sh.sum()), len(words)
    start = np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], n_sh) + np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(n_sh)])[:-1], n_sh)
    left = np.repeat(np.minimum(counts, size), n_sh)
    acc = left.astype(np.uint64)
    short = bool((left < size).any())
    for k in range(size):
        with np.errstate(over="ignore"):
            at = np.minimum(start + k, max(n - 1, 0)) if short else start + k
            nxt = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + words[at]) if total else acc
        acc = np.where(k < left, nxt, acc) if short else nxt
    return acc, n_sh


def ragged_take(values: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[offs[i]:offs[i + 1]]`` for every i of ``which``; returns it and each length."""
    lens = offs[which + 1] - offs[which]
    out = np.zeros(len(which) + 1, dtype=np.int64)
    np.cumsum(lens, out=out[1:])
    idx = np.repeat(offs[which] - out[:-1], lens) + np.arange(out[-1])
    return values[idx], lens
