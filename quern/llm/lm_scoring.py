"""Interpolated modified Kneser-Ney trigram model: counted in Spark, mapped by workers.

Counting moves packed arrays, not rows: a task sums what it has read and sends each
shard one sorted, delta-coded blob, so n-grams that one task sees often are one entry
and hot words cost no more than others.

1. Words: shards by the top bits of a 64-bit hash; each writes its sorted hashes, counts
   and running totals.  A word's number is its place in the sorted hashes of all shards.
2. Trigrams: the numbers of three words; two beginnings stand before a text.  The shard
   of a trigram is where it would lie if words followed each other independently
   (``total before w1 + count of w1 * (share before w2 + share of w2 * share before w3)``),
   so neither a frequent word nor a frequent pair lies in one shard.  A shard writes its
   sorted numbers as nested lists (w1, behind each its w2, behind each its w3) with counts, and sends
   on, by pair, the counts of counts behind a context and the different words before a pair.
3. Pairs: sums of those are the back-off weights of contexts and the continuation counts of
   pairs, which are counted in turn behind and before each word.
4. Words again: sums give each word's continuation count and back-off weight.

Scoring maps all shard files (``numpy.memmap``) and looks sorted keys up by binary search.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.packed import BLOB, blobs, by_shard, pack_sorted, pack_values, send, sum_by_key, unpack_sorted, unpack_values
from quern.llm.shared import Workspace, plan_bytes, replace_file
from quern.llm.text import slices, split_words, utf8

#: No word is empty or a space, so these stand for the end and the beginning of a text.
END_HASH, BEGIN_HASH = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"", b" "))
#: Word shards of a small table, and bytes of the table a shard beyond that; powers of two.
WORD_SHARDS, SHARD_BYTES = 64, 256 << 20
#: A stored count that stands for itself or more.
FULL = 255
#: Training tokens of a shard of pairs and trigrams, and the most and fewest shards.
SHARD_TOKENS, MIN_SHARDS, MAX_SHARDS = 1_000_000, 64, 65_536
#: Shards of pairs or trigrams that one task merges, one after the other.
TASK_SHARDS = 4
#: Entries a counting task holds before it sends its blobs.
HELD = 3_000_000
#: Text bytes handled at once: a larger slice has fewer distinct n-grams a token, and more lookups a shard.
SLICE = 8 << 20
#: Lookups in one stretch of numbers that are made in one call.
TOGETHER = 16
#: Low half of a key of two numbers.
LOW = np.uint64(2**32 - 1)
HALF = np.uint64(32)


def _write(path: str, a: np.ndarray) -> None:
    replace_file(path, [np.ascontiguousarray(a)])


def _code_type(rows: int) -> str:
    return "<u2" if rows <= 1 << 16 else "<u4"


def _write_coded(folder: str, name: str, shard: int, a: np.ndarray) -> None:
    """The distinct rows of ``a`` and the place of each row among them: most rows are small and alike."""
    code = np.zeros(len(a), np.int64)
    for column in a.T:
        values, rank = np.unique(column, return_inverse=True)
        code = np.unique(code * len(values) + rank, return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    _write(os.path.join(folder, f"{name}_row-{shard:05d}"), a[first].astype("<i8"))
    _write(os.path.join(folder, f"{name}-{shard:05d}"), code.astype(_code_type(len(first))))


def _write_counts(folder: str, name: str, shard: int, c: np.ndarray) -> None:
    """Counts in a byte each; those beyond lie beside, with their places."""
    _write(os.path.join(folder, f"{name}-{shard:05d}"), np.minimum(c, FULL).astype("u1"))
    over = np.flatnonzero(c >= FULL)
    if len(over):
        _write(os.path.join(folder, f"{name}_over-{shard:05d}"), np.stack([over, c[over]], 1).astype("<i8"))


def _write_rising(folder: str, name: str, shard: int, a: np.ndarray, dtype: str) -> None:
    """Numbers that never fall: the low bits that ``dtype`` holds, and the places where the bits above them rise by one."""
    bits = 8 * np.dtype(dtype).itemsize
    a = a.astype(np.int64)
    _write(os.path.join(folder, f"{name}-{shard:05d}"), (a & (1 << bits) - 1).astype(dtype))
    rise = np.searchsorted(a >> bits, np.arange(1, (int(a[-1]) >> bits) + 1)) if len(a) else a
    if len(rise):
        _write(os.path.join(folder, f"{name}_rise-{shard:05d}"), rise.astype("<i8"))


@dataclass
class Model:
    """The mapped arrays of a model folder; ``manifest`` holds sizes and discounts."""

    folder: str
    manifest: dict
    _open: dict = field(default_factory=dict)

    def array(self, name: str, shard: int, dtype: str) -> np.ndarray:
        key = (name, shard)
        if key not in self._open:
            path = os.path.join(self.folder, f"{name}-{shard:05d}")
            self._open[key] = np.asarray(np.memmap(path, np.dtype(dtype), "r")) if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, np.dtype(dtype))
        return self._open[key]

    @cached_property
    def base(self) -> np.ndarray:
        """Word number at which each word shard begins."""
        return np.concatenate([[0], np.cumsum(self.manifest["words"])]).astype(np.int64)

    @cached_property
    def tokens_before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.manifest["tokens"])]).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word number of each hash; -1 for words that training never saw."""
        out = np.full(len(hashes), -1, np.int64)
        shards = len(self.manifest["words"])
        shard = (hashes >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64)
        order = np.argsort(hashes)
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[s] : cut[s + 1]]
            known = self.array("hash", s, "<u8")
            if len(at) and len(known):
                p = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                out[at] = np.where(known[p] == hashes[at], p + self.base[s], -1)
        return out

    def by_word(self, name: str, numbers: np.ndarray, dtype: str) -> np.ndarray:
        """Values of a word array; 0 for number -1."""
        out = np.zeros(len(numbers), np.dtype(dtype))
        for s, at in self._word_shards(numbers):
            values = self.array(name, s, dtype)
            if len(values):
                out[at] = values[numbers[at] - self.base[s]]
        return out

    def counts(self, name: str, shard: int, places: np.ndarray) -> np.ndarray:
        """What ``_write_counts`` wrote at these places."""
        out = self.array(name, shard, "u1")[places].astype(np.int64)
        full = np.flatnonzero(out == FULL)
        if len(full):
            over = self.array(f"{name}_over", shard, "<i8").reshape(-1, 2)
            out[full] = over[np.searchsorted(over[:, 0], places[full]), 1]
        return out

    def rising(self, name: str, shard: int, places: np.ndarray, dtype: str) -> np.ndarray:
        """What ``_write_rising`` wrote at these places."""
        high = np.searchsorted(self.array(f"{name}_rise", shard, "<i8"), places, side="right")
        return high.astype(np.int64) << 8 * np.dtype(dtype).itemsize | self.array(name, shard, dtype)[places].astype(np.int64)

    def word_counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training count of each word; 0 for number -1."""
        out = np.zeros(len(numbers), np.int64)
        for s, at in self._word_shards(numbers):
            out[at] = self.counts("count", s, numbers[at] - self.base[s])
        return out

    def behind(self, numbers: np.ndarray) -> np.ndarray:
        """Classes and sum of the counts behind each word; 0 for number -1."""
        out = np.zeros((len(numbers), 4), np.int64)
        for s, at in self._word_shards(numbers):
            codes, rows = self.coded("behind", s, 4)
            if len(codes):
                out[at] = rows[codes[numbers[at] - self.base[s]]]
        return out

    def coded(self, name: str, shard: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``_write_coded`` wrote: codes and the rows they stand for."""
        rows = self.array(name + "_row", shard, "<i8").reshape(-1, width)
        return self.array(name, shard, _code_type(len(rows))), rows

    def _word_shards(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(numbers, kind="stable")
        cut = np.searchsorted(numbers[order], self.base)
        for s in np.flatnonzero(np.diff(cut)).tolist():
            yield s, order[cut[s] : cut[s + 1]]

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of tokens before each word, share of the word)."""
        n = max(1, self.tokens_before[-1])
        before = np.zeros(len(numbers), np.int64)
        for s, at in self._word_shards(numbers):
            before[at] = self.tokens_before[s] + self.rising("before", s, numbers[at] - self.base[s], "<u4")
        return before / n, self.word_counts(numbers) / n

    def places(self, name: str, shard: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys among those ``_write_keys`` wrote, and which are there."""
        top, low = (self.array(f"{name}_{x}", shard, "<u4") for x in ("top", "low"))
        if not len(low):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        high = keys >> HALF
        r = np.minimum(np.searchsorted(top, high.astype(np.uint32)), len(top) - 1)
        start = self.rising(f"{name}_start", shard, r, "<u2")
        return _search(low, start, np.where(top[r] == high, self.rising(f"{name}_start", shard, r + 1, "<u2"), start), keys & LOW)

    def pairs(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Of each pair the different words before it, and the classes and sum of the counts behind it."""
        out = np.zeros((len(keys), 5), np.int64)
        for s, at in _groups(shard):
            p, found = self.places("pair", s, keys[at])
            codes, rows = self.coded("pair", s, 5)
            out[at[found]] = rows[codes[p[found]]]
        return out

    def trigram_counts(self, context: np.ndarray, last: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Counts of trigrams given as keys of their first two words and numbers of their last."""
        out = np.zeros(len(context), np.int64)
        for s, at in _groups(shard):
            r, found = self.places("context", s, context[at])
            at, r = at[found], r[found]
            start, end = (self.rising("trigram_start", s, x, "<u2") for x in (r, r + 1))
            p, found = _search(self.array("trigram", s, "<u4"), start, end, last[at])
            out[at[found]] = self.counts("trigram_count", s, p[found])
        return out


def _search(values: np.ndarray, start: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted number its place in its own sorted stretch of ``values``, and whether it is there."""
    place, found = start.astype(np.int64), np.zeros(len(start), bool)
    wanted = wanted.astype(values.dtype)
    # neighbours in one stretch are looked up together: frequent words have the longest stretches and the most neighbours
    edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (end[1:] != end[:-1]), [True]])) if len(place) else place
    many = np.flatnonzero(np.diff(edge) >= TOGETHER)
    one = place < end
    for a, z in zip(edge[many].tolist(), edge[many + 1].tolist()):
        lo, hi = int(place[a]), int(end[a])
        place[a:z] = lo + values[lo:hi].searchsorted(wanted[a:z])
        one[a:z] = False
    at = np.flatnonzero(one)
    low, left, want = place[at], end[at].astype(np.int64) - place[at], wanted[at]
    while len(at):
        half = left >> 1
        middle = low + half
        less = values[middle] < want
        low = np.where(less, middle + 1, low)
        left = np.where(less, left - half - 1, half)
        some = left > 0
        if not some.all():  # one gather a step for those that go on; the others are settled
            done = ~some
            place[at[done]] = low[done]
            at, low, left, want = at[some], low[some], left[some], want[some]
    inside = np.flatnonzero(place < end)
    found[inside] = values[place[inside]] == wanted[inside]
    return place, found


def _write_keys(folder: str, name: str, shard: int, keys: np.ndarray) -> None:
    """Sorted keys of two numbers: the distinct high ones, where each begins, and the low ones."""
    high = keys >> HALF
    first = np.flatnonzero(np.diff(high, prepend=np.uint64(2**63)))
    _write(os.path.join(folder, f"{name}_top-{shard:05d}"), high[first].astype("<u4"))
    _write(os.path.join(folder, f"{name}_low-{shard:05d}"), (keys & LOW).astype("<u4"))
    _write_rising(folder, f"{name}_start", shard, np.append(first, len(keys)), "<u2")


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places that name it."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
        yield int(shard[order[a]]), order[a:b]


@lru_cache(maxsize=2)
def open_model(folder: str, stage: str = "finished") -> Model:
    """A worker's handle to a model; at stage "words" it has the word arrays alone."""
    with open(os.path.join(folder, f"{stage}.json")) as f:
        return Model(folder, json.load(f))


def word_hash_slice(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, place of every token in them, tokens of each row); each row ends in END."""
    raw, offs = utf8(column)
    w = split_words(raw, offs)
    h = np.append(w.hashes(), END_HASH)
    ids = np.insert(w.ids.astype(np.int64), np.cumsum(w.counts), len(h) - 1)
    return h, ids, w.counts + 1


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the counts of counts 1 to 4.

    Where a class is empty (tiny corpora) its discount is half the count it applies to.
    """
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(x, 0.0), k) if x > 0 else 0.5 for x, k in zip(d, (1, 2, 3))]


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _count_words(folder: str, shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0

        def flush():
            k, v = sum_by_key(keys, values)
            keys.clear(), values.clear()
            yield from send(blobs((k >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64), k, v))

        for b in slices(batches, "text", SLICE):
            h, ids, n = word_hash_slice(b.column(0))
            keys.append(np.append(h, BEGIN_HASH))
            values.append(np.append(np.bincount(ids, minlength=len(h)), len(n)))
            held += len(h)
            if held >= HELD:
                yield from flush()
                held = 0
        if keys:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for s, keys, values in by_shard(batches):
            k, c = sum_by_key([unpack_sorted(x) for x in keys], [unpack_values(x) for x in values])
            _write(os.path.join(folder, f"hash-{s:05d}"), k.astype("<u8"))
            _write_counts(folder, "count", s, c)
            _write_rising(folder, "before", s, np.cumsum(c) - c, "<u4")
            out.append((s, len(k), int(c.sum())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["shard", "words", "tokens"])

    return count, merge


def _shards(model: Model, a1: np.ndarray, b1: np.ndarray, rest: np.ndarray) -> np.ndarray:
    s = model.manifest["gram_shards"]
    return np.clip(((a1 + b1 * rest) * s).astype(np.int64), 0, s - 1)


def _pair_shards(model: Model, keys: np.ndarray) -> np.ndarray:
    """Shard of each pair; every step computes it here, from the key alone."""
    words, at = np.unique(np.concatenate([keys >> HALF, keys & LOW]).astype(np.int64), return_inverse=True)
    a, b = model.spread(words)
    w1, w2 = at[: len(keys)], at[len(keys) :]
    return _shards(model, a[w1], b[w1], a[w2])


def _grams(column: pa.Array):
    """A slice's sorted hashes with BEGIN, ids and tokens a row; its distinct pairs (the last
    is two beginnings); pair that ends at and pair that stands before each token.

    Ids follow the hashes and so the numbers of words: lookups walk through the model in order.
    """
    h, ids, n = word_hash_slice(column)
    h = np.append(h, BEGIN_HASH)
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    ids, begin = rank[ids], int(rank[-1])
    starts = np.cumsum(n) - n
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts] = begin
    pairs, ends = np.unique(before.astype(np.uint64) << HALF | ids.astype(np.uint64), return_inverse=True)
    context = np.empty_like(ends)
    context[1:] = ends[:-1]
    context[starts] = len(pairs)
    return h[order], ids, n, np.append(pairs, np.uint64(begin << 32 | begin)), ends, context


def _in_numbers(numbers: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Keys of pairs of known words."""
    return numbers[pairs >> HALF].astype(np.uint64) << HALF | numbers[pairs & LOW].astype(np.uint64)


def _sum_trigrams(context: np.ndarray, last: np.ndarray, values: np.ndarray):
    """(sorted distinct contexts, keys of place in them << 32 | last word, sums)."""
    contexts, place = np.unique(context, return_inverse=True)
    return contexts, *sum_by_key([place.astype(np.uint64) << HALF | last.astype(np.uint64)], [values])


def _count_trigrams(folder: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_model(folder, "words")
        held: list[tuple] = []

        def flush():
            context, last, shard, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for s, at in _groups(shard):
                contexts, key, sums = _sum_trigrams(context[at], last[at], c[at])
                yield s, pack_sorted(contexts[key >> HALF]), pack_values(np.concatenate([(key & LOW).astype(np.int64), sums]))

        for b in slices(batches, "text", SLICE):
            h, ids, _, pairs, _, before = _grams(b.column(0))
            numbers = model.numbers(h)
            share, own = model.spread(numbers)
            key, c = np.unique(before.astype(np.uint64) << HALF | ids.astype(np.uint64), return_counts=True)
            pair, last = pairs[key >> HALF], key & LOW
            w1, w2 = pair >> HALF, pair & LOW
            shard = _shards(model, share[w1], own[w1], share[w2] + own[w2] * share[last])
            held.append((_in_numbers(numbers, pairs)[key >> HALF], numbers[last].astype(np.uint32), shard.astype(np.int32), c))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from send(flush())
        if held:
            yield from send(flush())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_model(folder, "words")
        for s, keys, values in by_shard(batches):
            values = [unpack_values(x).reshape(2, -1) for x in values]
            contexts, key, c = _sum_trigrams(np.concatenate([unpack_sorted(x) for x in keys]), *np.concatenate(values, 1))
            place = key >> HALF
            first = np.flatnonzero(np.diff(place, prepend=np.uint64(2**63)))
            _write_keys(folder, "context", s, contexts)
            _write_rising(folder, "trigram_start", s, np.append(first, len(key)), "<u2")
            _write(os.path.join(folder, f"trigram-{s:05d}"), (key & LOW).astype("<u4"))
            _write_counts(folder, "trigram_count", s, c)
            # of pairs: words before, and what is behind them as contexts
            pairs, different = np.unique((contexts & LOW)[place] << HALF | key & LOW, return_counts=True)
            behind = _classes(c, first)
            yield from send(blobs(_pair_shards(model, contexts), contexts, np.insert(behind, 0, 0, axis=1)))
            yield from send(blobs(_pair_shards(model, pairs), pairs, np.pad(different[:, None], ((0, 0), (0, 4)))))
            # counts of counts, by the way: shard -1
            yield from send(iter([(-1, pack_sorted(np.arange(4)), pack_values(np.array(_counts_of_counts(c))))]))

    return count, merge


def _classes(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of counts: how many are 1, 2, more, and their sum."""
    return np.add.reduceat(np.stack([c == 1, c == 2, c >= 3, c], 1).astype(np.int64), first, axis=0)


def _merge_pairs(folder: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_model(folder, "words")
        words = len(model.manifest["words"])
        for s, keys, values in by_shard(batches):
            width = 1 if s < 0 else 5
            k, c = sum_by_key([unpack_sorted(x) for x in keys], [unpack_values(x).reshape(-1, width) for x in values])
            if s < 0:
                yield from send(iter([(s, pack_sorted(k), pack_values(c.ravel()))]))
                continue
            _write_keys(folder, "pair", s, k)
            _write_coded(folder, "pair", s, c)
            k, c = k[c[:, 0] > 0], c[c[:, 0] > 0, 0]  # two beginnings are a context alone
            if not len(k):
                continue
            # behind a word: shards from 0; before a word: shards beyond those
            w1 = k >> HALF
            first = np.flatnonzero(np.diff(w1, prepend=np.uint64(2**63)))
            w2, different = np.unique(k & LOW, return_counts=True)
            yield from send(blobs(_word_shards(model, w1[first]), w1[first], _classes(c, first)))
            yield from send(blobs(_word_shards(model, w2) + words, w2, different))
            yield from send(iter([(-2, pack_sorted(np.arange(4)), pack_values(np.array(_counts_of_counts(c))))]))

    return merge


def _word_shards(model: Model, numbers: np.ndarray) -> np.ndarray:
    return np.searchsorted(model.base, numbers.astype(np.int64), side="right") - 1


def _merge_words(folder: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_model(folder, "words")
        words = len(model.manifest["words"])
        out = []
        for s, keys, values in by_shard(batches):
            if s < 0:
                k, v = sum_by_key([unpack_sorted(x) for x in keys], [unpack_values(x) for x in values])
                out.append((s, *v.tolist(), 0, 0))
            elif s < words:
                k, v = sum_by_key([unpack_sorted(x) for x in keys], [unpack_values(x).reshape(-1, 4) for x in values])
                full = np.zeros((model.manifest["words"][s], 4), np.int64)
                full[k.astype(np.int64) - model.base[s]] = v
                _write_coded(folder, "behind", s, full)
            else:
                s -= words
                k, v = sum_by_key([unpack_sorted(x) for x in keys], [unpack_values(x) for x in values])
                full = np.zeros(model.manifest["words"][s], np.int64)
                full[k.astype(np.int64) - model.base[s]] = v
                _write(os.path.join(folder, f"cont-{s:05d}"), full.astype("<u4"))
                out.append((s, *_counts_of_counts(full), int((full > 0).sum()), int(full.sum())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["shard", "c1", "c2", "c3", "c4", "some", "total"])

    return merge


def train(df: DataFrame, ws: Workspace, *, text: str = "text") -> str:
    """Count a model from all rows of ``df``; returns its folder."""
    spark = df.sparkSession
    folder = ws.folder("model")
    n_out = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    src = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    shards = WORD_SHARDS << min(10, max(0, math.ceil(math.log2(max(1, (plan_bytes(src) or 1) / (WORD_SHARDS * SHARD_BYTES))))))
    n_out *= shards // WORD_SHARDS
    count, merge = _count_words(folder, shards)
    dealt = lambda packed: packed.repartition(max(n_out, manifest.get("gram_shards", 0) // TASK_SHARDS), "shard").sortWithinPartitions("shard")
    manifest: dict = {"words": [0] * shards, "tokens": [0] * shards}
    sizes = dealt(src.mapInArrow(count, BLOB)).mapInArrow(merge, "shard long, words long, tokens long").collect()
    ws.free()  # the shuffle of words
    for r in sizes:
        manifest["words"][r.shard], manifest["tokens"][r.shard] = r.words, r.tokens
    vocabulary = sum(manifest["words"])
    if vocabulary >= 2**32:
        raise ValueError("more distinct words than 32 bits number")
    total = sum(manifest["tokens"])
    manifest["gram_shards"] = int(min(MAX_SHARDS, max(MIN_SHARDS, math.ceil(total / SHARD_TOKENS))))

    def save(stage: str) -> None:
        replace_file(os.path.join(folder, f"{stage}.json"), [json.dumps(manifest).encode()])

    save("words")
    first = Model(folder, manifest)
    begins = int(first.word_counts(first.numbers(np.array([BEGIN_HASH])))[0])
    count, merge = _count_trigrams(folder)
    by_pair = dealt(src.mapInArrow(count, BLOB)).mapInArrow(merge, BLOB)
    by_word = dealt(by_pair).mapInArrow(_merge_pairs(folder), BLOB)
    rows = dealt(by_word).mapInArrow(_merge_words(folder), "shard long, c1 long, c2 long, c3 long, c4 long, some long, total long").collect()
    raw, middle, cont, some, pairs = [0] * 4, [0] * 4, [0] * 4, 0, 0
    for r in rows:
        c = [r.c1, r.c2, r.c3, r.c4]
        if r.shard == -1:
            raw = [a + b for a, b in zip(raw, c)]
        elif r.shard == -2:
            middle = [a + b for a, b in zip(middle, c)]
        else:
            cont, some, pairs = [a + b for a, b in zip(cont, c)], some + r.some, pairs + r.total
    manifest |= {
        "begins": begins, "n": total - begins, "v": max(0, vocabulary - (1 if begins else 0)), "pairs": pairs,
        "discounts": discounts(raw), "pair_discounts": discounts(middle), "word_discounts": discounts(cont), "word_classes": [cont[0], cont[1], some - cont[0] - cont[1]],
    }
    save("finished")
    return folder


def _backoff(behind: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total count behind each context (1 at least) and the share its discounts leave; all where nothing follows."""
    total = np.maximum(behind[:, 3], 1)
    return total, np.where(behind[:, 3] > 0, sum(behind[:, k] * d[k + 1] for k in range(3)) / total, 1.0)


def score_column(model: Model, column: pa.Array) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each row."""
    m = model.manifest
    h, ids, n, pairs, ends, context = _grams(column)
    numbers = model.numbers(h)
    count = model.word_counts(numbers)
    base = np.log10((count + 1) / (m["n"] + 1 * (m["v"] + 1)))
    # words: continuation counts, interpolated with an equal share for each word and one more
    cont = model.by_word("cont", numbers, "<u4").astype(np.int64)
    d = m["word_discounts"]
    if m["pairs"]:
        free = sum(x * y for x, y in zip(d, m["word_classes"])) / m["pairs"]
        single = np.maximum(cont - np.array([0.0, *d])[np.minimum(cont, 3)], 0) / m["pairs"] + free / (m["v"] + 1)
    else:
        single = np.full(len(h), 1 / (m["v"] + 1))
    # pairs: continuation counts
    w1, w2 = pairs >> HALF, pairs & LOW
    known = np.flatnonzero((numbers[w1] >= 0) & (numbers[w2] >= 0))
    keys = _in_numbers(numbers, pairs[known])
    share, own = model.spread(numbers)
    shard = _shards(model, share[w1[known]], own[w1[known]], share[w2[known]])
    c, behind = np.zeros(len(pairs), np.int64), np.zeros((len(pairs), 4), np.int64)
    got = model.pairs(keys, shard)
    c[known], behind[known] = got[:, 0], got[:, 1:]
    d = np.array([0.0, *m["pair_discounts"]])
    total, backoff = _backoff(model.behind(numbers), d)
    double = np.maximum(c - d[np.minimum(c, 3)], 0) / total[w1] + backoff[w1] * single[w2]
    # trigrams: counts
    key, at = np.unique(context.astype(np.uint64) << HALF | ids.astype(np.uint64), return_inverse=True)
    place, last = key >> HALF, key & LOW
    seen = np.flatnonzero((behind[place, 3] > 0) & (numbers[last] >= 0))
    pair, last = pairs[place[seen]], last[seen]
    shard = _shards(model, share[pair >> HALF], own[pair >> HALF], share[pair & LOW] + own[pair & LOW] * share[last])
    c = np.zeros(len(key), np.int64)
    c[seen] = model.trigram_counts(_in_numbers(numbers, pair), numbers[last], shard)
    c = c[at]
    d = np.array([0.0, *m["discounts"]])
    total, backoff = _backoff(behind, d)
    p = np.maximum(c - d[np.minimum(c, 3)], 0) / total[context] + backoff[context] * double[ends]
    rows = np.repeat(np.arange(len(n)), n)
    sums = lambda x: np.bincount(rows, weights=x, minlength=len(n))
    return {"n_tokens": n, "n_known": sums(count[ids] > 0).astype(np.int64), "base_score": sums(base[ids]), "score": sums(np.log10(p))}


def score(df: DataFrame, folder: str, *, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of the whole text with its end; null texts are empty.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    kept = [c for c in df.columns if c not in made]
    at = kept.index(text)
    src = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = src.drop(text).withColumns({c: F.lit(0).cast("long" if c[-5:] in ("okens", "known") else "double") for c in made}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_model(folder)
        for b in slices(batches, text, SLICE):
            got = score_column(model, b.column(at))
            got["train_tokens"] = np.full(b.num_rows, model.manifest["n"], np.int64)
            got["perplexity"] = 10 ** np.minimum(-got["score"] / got["n_tokens"], 300)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), *(pa.array(got[c]) for c in made)], names=[*(c for c in kept if c != text), *made])

    return src.mapInArrow(run, schema)


def lm_scoring(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2, work_dir: str | None = None) -> DataFrame:
    """Train on all folds but one, score every row.

    A row's fold is crc32 of its id as text modulo ``folds``; a null id counts as the
    empty text.  Returns doc_id, held_out and what ``score`` adds.
    """
    ws = Workspace(df.sparkSession, "lm", work_dir)
    fold = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % folds
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), (fold == held_fold).alias("held_out"), F.col(f"`{text}`").alias("text"))
    folder = train(src.where("NOT held_out"), ws)
    return score(src, folder)
