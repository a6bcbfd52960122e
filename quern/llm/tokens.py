"""Token ids and token counts of whole texts.

``ChunkEncoder`` gives the ids of the tokenizers library; ``RankMerger`` counts
byte-level BPE tokens with numpy alone.  Both cut texts into chunks at places where
the tokenizer's own splitting pattern always cuts, so each distinct chunk of a slice
is handled once and the ids of a text are those of its chunks in order.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.text import LOWER, encode_runs, held, ragged_take, slices, table, utf8

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
SPACES = table((0x20, 0x20), (0x09, 0x0D))
LETTERS = table((0x41, 0x5A), (0x61, 0x7A))
MARKS = table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: White space beyond ASCII, which the byte rules do not see, and the beginning of special
#: tokens, which they may cut: texts with either are encoded whole.
WHOLE = "<\\||[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: The pattern that byte-level BPE splits with, as its vocabulary file's library has it built in.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern of tokenizers that drop white space and write all in lower case, and chunks that it takes whole:
#: small letters that NFC and lower case leave as they are. Their ids are those of the model alone.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "^[a-z\\x{e0}-\\x{f6}\\x{f8}-\\x{ff}]+$"
#: Distinct chunks a worker remembers between slices; beyond, encoders keep the common ones.
MEMORY = 500_000


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _space_runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(white space, first byte of a run of it, first byte of a row), as flags of each byte."""
    s = SPACES[raw]
    row = np.zeros_like(s)
    row[offs[:-1][offs[1:] > offs[:-1]]] = True
    first = s.copy()
    first[1:] &= ~s[:-1]
    return s, first | (s & row), row


def _word_edges(raw: np.ndarray) -> np.ndarray:
    """Bytes that start a chunk inside a word: between an ASCII letter and ASCII punctuation.

    Both patterns always end a match there, but for an apostrophe before letters
    ('s and the like), which therefore stays with them.
    """
    letter, mark = LETTERS[raw], MARKS[raw]
    edge = np.zeros_like(letter)
    edge[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & (raw[:-1] != 0x27) & letter[1:])
    return edge


def byte_level_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Chunk starts that byte-level BPE's pattern never matches across.

    A run of white space starts a chunk and takes the word behind it along, except
    that a lone line feed stands for itself: the pattern never joins it to a word.
    """
    s, first, row = _space_runs(raw, offs)
    lone = np.zeros_like(s)
    lone[1:] = first[:-1] & (raw[:-1] == 0x0A)
    return np.flatnonzero(first | row | (lone & ~s) | _word_edges(raw))


def word_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Chunk starts for tokenizers that drop white space."""
    s, first, row = _space_runs(raw, offs)
    after = np.zeros_like(s)
    after[1:] = s[:-1]
    return np.flatnonzero(first | row | (after & ~s) | _word_edges(raw))


class Chunks:
    """Chunks of a slice: of each its dictionary entry, of each row how many it has."""

    def __init__(self, raw, offs, starts_of):
        starts = starts_of(raw, offs)
        lens = np.diff(np.append(starts, len(raw)))
        self.ids, dictionary = encode_runs(raw, starts, lens)
        self.counts = np.diff(np.searchsorted(starts, offs))
        self.dictionary = dictionary
        self.keys = dictionary.to_numpy(zero_copy_only=False).tolist()

    def rows_with(self, bad: np.ndarray) -> np.ndarray:
        """Rows that have a chunk for which ``bad`` holds."""
        if not bad.any():
            return np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(self.counts)), self.counts)
        return np.unique(rows[bad[self.ids]])


def lower_alone(raw: np.ndarray) -> np.ndarray:
    """``raw`` with A-Z lowered but before bytes beyond ASCII, where a mark may join the letter in NFC."""
    out = LOWER[raw]
    joined = np.flatnonzero((raw[1:] >= 0x80) & (raw[:-1] < 0x80))
    out[joined] = raw[joined]
    return out


def lowers_words(spec: dict) -> bool:
    """Whether a tokenizer is NFC, lower case, ``WORD_LEVEL`` and byte-level BPE, and nothing else acts on letters."""
    norm, pre, model = ((spec[k] or {}) for k in ("normalizer", "pre_tokenizer", "model"))
    steps, cuts = norm.get("normalizers", []), pre.get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORD_LEVEL} and cuts[0]["invert"]
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and spec["post_processor"] is None and model["type"] == "BPE" and not model["dropout"]
    )


def byte_alphabet() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: printable ones themselves, the rest 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}


def needs_whole(dictionary: pa.Array) -> np.ndarray:
    flags = pc.match_substring_regex(dictionary.cast(pa.large_string()), WHOLE)
    return flags.to_numpy(zero_copy_only=False).astype(bool)


class ChunkEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, name: str = BYTE_BPE, memory: int | None = None):
        self.memory = memory or MEMORY
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        byte_level = spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["normalizer"] is None
        self.starts_of = byte_level_starts if byte_level else word_starts
        self.lowers, self.alphabet = lowers_words(spec), byte_alphabet()
        mark = spec["added_tokens"][-1]
        self.mark, self.mark_id = mark["content"], mark["id"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.offs = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int32)  # slices that had each chunk

    def thin(self) -> None:
        """Keep the chunks that most slices had, at most half the memory; most chunks are had by one."""
        least = 2
        while np.count_nonzero(self.seen >= least) > self.memory // 2:
            least += 1
        stay = np.flatnonzero(self.seen >= least)
        keys = list(self.at)
        self.at = {keys[i]: n for n, i in enumerate(stay.tolist())}
        self.flat, lens = ragged_take(self.flat, self.offs, stay)
        self.offs = np.concatenate([[0], np.cumsum(lens)])
        self.seen = self.seen[stay] // 2  # what is no longer met goes in time

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, keys: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Chunks that are one word of the model as they are, and the others."""
        if not self.lowers:
            return [], keys
        flags = pc.match_substring_regex(pa.array(keys, pa.large_binary()).cast(pa.large_string()), PLAIN).to_pylist()
        return [k for k, f in zip(keys, flags) if f], [k for k, f in zip(keys, flags) if not f]

    def learn(self, keys: list[bytes]) -> None:
        """Encode new chunks: plain ones by the model, others joined by a special token, which texts are always cut at."""
        parts, lens = [], []
        words, keys = self.plain(keys)
        if words:
            tokenize = self.tokenizer.model.tokenize
            got = [[t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(self.alphabet))] for w in words]
            parts.append(np.fromiter(chain.from_iterable(got), np.uint32))
            lens.append(np.fromiter(map(len, got), np.int64, len(got)))
        groups = [keys[i : i + 4000] for i in range(0, len(keys), 4000)]
        mark = self.mark.encode()
        joined = [mark.join(g) for g in groups]
        for i, g in enumerate(groups):
            if joined[i].count(mark) != len(g) - 1:  # a chunk has the mark itself: its text is encoded whole
                joined[i] = mark.join(x.replace(mark, b"") for x in g)
        for ids in self.whole([x.decode() for x in joined]):
            cut = np.flatnonzero(ids == self.mark_id)
            parts.append(np.delete(ids, cut))
            lens.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
        base, keys = len(self.at), words + keys
        self.at.update(zip(keys, range(base, base + len(keys))))
        self.flat = np.concatenate([self.flat, *parts])
        self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(np.concatenate(lens))])
        self.seen = np.concatenate([self.seen, np.zeros(len(keys), np.int32)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, ids of each row)."""
        raw, offs = utf8(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        c = Chunks(lower_alone(raw) if self.lowers else raw, offs, self.starts_of)
        new = [k for k in c.keys if k not in self.at]
        if len(self.at) + len(new) > self.memory and self.at:
            self.thin()
            new = [k for k in c.keys if k not in self.at]
        if new:
            self.learn(new)
        get = self.at.__getitem__
        slot = np.fromiter(map(get, c.keys), np.int64, len(c.keys))
        self.seen[slot] += 1
        ids, lens = ragged_take(self.flat, self.offs, slot[c.ids])
        total = np.concatenate([[0], np.cumsum(lens)])
        ends = total[np.cumsum(c.counts)]
        counts = np.diff(ends, prepend=0)
        odd = c.rows_with(needs_whole(c.dictionary))
        if len(odd):
            own = dict(zip(odd.tolist(), self.whole([raw[offs[r] : offs[r + 1]].tobytes().decode() for r in odd])))
            begin = ends - counts
            ids = np.concatenate([own[r] if r in own else ids[begin[r] : ends[r]] for r in range(len(counts))])
            for r, x in own.items():
                counts[r] = len(x)
        return ids, counts


def chunk_encoder(name: str = BYTE_BPE, memory: int | None = None) -> ChunkEncoder:
    """One encoder a worker process: its memory of chunks outlives a task (see ``held``)."""
    return held(("encoder", name, memory), lambda: ChunkEncoder(name, memory))


class RankMerger:
    """Byte-level BPE counts by rank-synchronous merging.

    Pre-tokens lie one behind the other in one symbol array.  A round looks up the
    rank of every adjacent pair, takes the lowest of each sequence
    (``minimum.reduceat``) and merges it at all of its places at once; sequences
    without a pair leave the array, their symbol count is their token count.
    """

    def __init__(self, name: str = BYTE_BPE):
        import regex

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        self.first = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        made = {}
        keys, out = np.empty(len(merges), np.int64), np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            if made.get(a, -1) >= r or made.get(b, -1) >= r or a + b in made:
                raise ValueError("merging all places of a pair at once needs merges in the order of training")
            made[a + b] = r
            keys[r], out[r] = vocab[a] << 32 | vocab[b], vocab[a + b]
        self.out, self.none = out, len(merges)
        self._index(keys)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(t) for t in self.specials)) if self.specials else None
        self.pattern = regex.compile(BYTE_LEVEL)
        self.known: dict[bytes, int] = {}

    def _index(self, keys: np.ndarray) -> None:
        """Open addressing with linear probes; ``longest`` bounds every search."""
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 8 + 1))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, self.none, np.int32)
        at, todo, self.longest = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.slots[at] == -1
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            self.slots[at[wins]], self.slot_rank[at[wins]] = keys[todo[wins]], todo[wins]
            at, todo = (at[~wins] + 1) & ((1 << self.bits) - 1), todo[~wins]
            self.longest += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``none`` if it never merges."""
        key = a << 32 | b
        at = self._slot(key)
        got = self.slots[at]
        rank = np.where(got == key, self.slot_rank[at], np.int32(self.none))
        left = np.flatnonzero((got != key) & (got != -1))
        for _ in range(self.longest - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[left]]
            ok = got == key[left]
            rank[left[ok]] = self.slot_rank[at[left[ok]]]
            left = left[~ok & (got != -1)]
        return rank

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, special tokens) of a text or chunk."""
        if self.special and "<|" in text:
            parts = self.special.split(text)
            return [p for s in parts for p in self.pattern.findall(s)], len(parts) - 1
        return self.pattern.findall(text), 0

    def merged_lengths(self, raw: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Token count of each byte sequence."""
        none = np.int32(self.none)
        sym = self.first[raw]
        result = lens.astype(np.int64).copy()
        live = np.flatnonzero(lens > 1)
        if len(live) < len(lens):
            sym = sym[np.repeat(lens > 1, lens)]
        n = result[live]
        if not len(live):
            return result
        rank = np.full(len(sym), none)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(n) - 1] = none
        while len(live):
            start = np.cumsum(n) - n
            low = np.minimum.reduceat(rank, start)
            where = np.flatnonzero((rank == np.repeat(low, n)) & (rank < none))
            follows = np.zeros(len(where), bool)
            follows[1:] = where[1:] == where[:-1] + 1
            if follows.any():  # a pair of equal symbols may overlap itself: every second place counts
                idx = np.arange(len(where))
                run = np.maximum.accumulate(np.where(follows, 0, idx))
                where = where[(idx - run) % 2 == 0]
            sym[where] = self.out[rank[where]]
            rank[where] = -1
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            n = n - np.diff(np.searchsorted(where, np.append(start, len(sym))))
            result[live] = n
            going = (low < none) & (n > 1)
            old = np.diff(np.append(start, len(sym)))
            stay &= np.repeat(going, old)
            # a merge that used up the end of a sequence leaves its new symbol last there
            sym, rank, live, n = sym[stay], rank[stay], live[going], n[going]
            if not len(live):
                break
            last = np.zeros(len(sym), bool)
            last[np.cumsum(n) - 1] = True
            fresh = np.flatnonzero(rank == -1)
            touched = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1]))
            touched = touched[touched < len(sym) - 1]
            rank[touched] = self.ranks(sym[touched], sym[touched + 1])
            rank[last] = none
        return result

    def count_texts(self, texts: list[str]) -> np.ndarray:
        pieces, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            p, extra = self.pre_tokens(t)
            total[i] = extra
            pieces += p
            owner.append(len(p))
        if not pieces:
            return total
        enc = [p.encode() for p in pieces]
        lens = np.fromiter(map(len, enc), np.int64, len(enc))
        got = self.merged_lengths(np.frombuffer(b"".join(enc), np.uint8), lens)
        return total + np.bincount(np.repeat(np.arange(len(texts)), owner), weights=got, minlength=len(texts)).astype(np.int64)

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row."""
        raw, offs = utf8(column)
        if not len(raw):
            return np.zeros(len(offs) - 1, np.int64)
        c = Chunks(raw, offs, byte_level_starts)
        new = [k for k in c.keys if k not in self.known]
        if len(self.known) + len(new) > MEMORY and self.known:
            self.known, new = {}, c.keys
        if new:
            self.known.update(zip(new, self.count_texts([k.decode() for k in new]).tolist()))
        per = np.fromiter(map(self.known.__getitem__, c.keys), np.int64, len(c.keys))
        total = np.concatenate([[0], np.cumsum(per[c.ids])])
        ends = total[np.cumsum(c.counts)]
        counts = np.diff(ends, prepend=0)
        odd = c.rows_with(needs_whole(c.dictionary))
        if len(odd):
            counts[odd] = self.count_texts([raw[offs[r] : offs[r + 1]].tobytes().decode() for r in odd])
        return counts


def rank_merger(name: str = BYTE_BPE) -> RankMerger:
    return held(("merger", name), lambda: RankMerger(name))


def token_counts(df: DataFrame, *, text: str = "text", tokenizer: str = BYTE_BPE, limit: int = 1024) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens``, ``over_limit`` to every row; other columns stay.

    Null and empty texts have 0 bytes and 0 tokens.  Columns of these names are replaced.
    One narrow pass: no shuffle, memory bounded by ``SLICE_BYTES`` and ``MEMORY``.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in df.columns if c not in made]
    at = kept.index(text)
    src = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = src.withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = rank_merger(tokenizer)
        for b in slices(batches, text):
            col = b.column(at)
            n = merger.count(col)
            size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, size, pa.array(n), pa.array(n > limit)], names=[*kept, *made])

    return src.mapInArrow(run, schema)
