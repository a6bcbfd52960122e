"""Benchmark decontamination by exact n-gram windows.

The benchmark's windows are a set of known size that workers get as a broadcast;
documents are scanned once, without a shuffle.  Only words of the benchmark have a
number, so a window can match only inside a run of numbered words; hashes of those
windows are looked up, and every hit is verified on the word numbers themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import Workspace, free_name
from quern.llm.text import ALNUM_WORD, SLICE_BYTES, mix64, slices, split_words, utf8

#: Benchmark text that one broadcast may hold; a larger benchmark takes a pass for each block of about this size.
BLOCK_BYTES = 8 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class WindowSet:
    """Windows of a block of benchmark items, by their length in words."""

    items: list[str | None]
    words: dict[bytes, int] = field(default_factory=dict)  # numbered from 1
    by_length: dict[int, tuple] = field(default_factory=dict)  # length -> hashes, window rows, item lists

    @classmethod
    def build(cls, items: list[tuple[str | None, str]], size: int) -> WindowSet:
        out = cls([i for i, _ in items])
        raw, offs = utf8(pa.array([t for _, t in items], pa.large_string()))
        w = split_words(raw, offs, ALNUM_WORD)
        out.words = {k: i + 1 for i, k in enumerate(w.dictionary.to_pylist())}
        ids, start = w.ids.astype(np.int64) + 1, w.row_start
        found: dict[int, dict[tuple, set[int]]] = {}
        for n, (a, b) in enumerate(zip(start[:-1], start[1:])):
            length = min(size, b - a)
            for k in range(a, b - length + 1) if length else ():
                found.setdefault(int(length), {}).setdefault(tuple(ids[k : k + length].tolist()), set()).add(n)
        for length, windows in found.items():
            rows = np.array(list(windows), np.int64).reshape(len(windows), length)
            h = window_hashes(rows.ravel(), np.arange(len(rows)) * length, length)
            order = np.argsort(h, kind="stable")
            owners = list(windows.values())
            out.by_length[length] = (h[order], rows[order], [sorted(owners[k]) for k in order])
        return out

    def scan(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, window length, window row) of every verified occurrence."""
        rows_end = np.repeat(np.cumsum(counts), counts)
        known = np.where(ids > 0, 1, 0)
        # words from here to the end of the run of numbered words, within the row
        stop = np.flatnonzero(known == 0)
        nxt = np.append(stop, len(ids))[np.searchsorted(stop, np.arange(len(ids)))]
        run = np.minimum(nxt, rows_end) - np.arange(len(ids))
        for length, (hashes, rows, _) in self.by_length.items():
            at = np.flatnonzero(run >= length)
            if not len(at):
                continue
            h = window_hashes(ids, at, length)
            lo, hi = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for r in range(a, b):
                    if np.array_equal(ids[p : p + length], rows[r]):
                        yield p, length, r


def window_hashes(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    acc = np.full(len(at), np.uint64(length))
    for k in range(length):
        acc = mix64(acc * PRIME + ids[at + k].astype(np.uint64))
    return acc


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of about ``limit`` text bytes, one of them on the driver at a time.

    Null texts have no words, null ids stay.  An item's block follows from its text.
    """
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // limit))
    for k in range(n):
        yield [(r.i, r.t) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)).collect()]


def find_spans(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, limit: int = BLOCK_BYTES, names: tuple[str, str] = ("_n_words", "_spans")) -> DataFrame:
    """``df`` with the words of each row and the spans of windows in it (columns ``names``, which ``df`` must not have).

    Spans list every occurrence of a window: first and last word (from 0), its byte range in
    the text, the items that have it.  A benchmark beyond ``limit`` bytes is taken in blocks: a
    pass over the rows each, written before the next, so a worker holds one block at a time.
    Null texts have no words; an empty benchmark gives no spans.
    """
    if set(names) & set(df.columns):
        raise ValueError(f"columns {names} are taken: pass other names")
    ws, done = Workspace(df.sparkSession, "windows"), None
    earlier = free_name([*df.columns, *names], "spans_before")
    for number, block in enumerate(_blocks(benchmark, item_id, item_text, limit)):
        if done is None:
            done = _scan_block(df, block, text, size, names)
            continue
        # the next pass reads what the last has written
        written = ws.keep(done, f"pass-{number}").withColumnRenamed(names[1], earlier).drop(names[0])
        ws.free(f"pass-{number - 1}")
        done = _scan_block(written, block, text, size, names).withColumn(names[1], F.concat(earlier, names[1])).drop(earlier)
    return done


def _scan_block(df: DataFrame, items: list[tuple[str | None, str]], text: str, size: int, names: tuple[str, str]) -> DataFrame:
    block = df.sparkSession.sparkContext.broadcast(WindowSet.build(items, size))
    kept = df.columns
    at = kept.index(text)
    src = df.select(*[F.col(f"`{c}`") for c in kept])
    span = "array<struct<first:bigint,last:bigint,from:bigint,to:bigint,items:array<string>>>"
    schema = src.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.lit(None).cast(span)}).schema
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("items", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = block.value
        for b in slices(batches, text, SLICE_BYTES):
            raw, offs = utf8(b.column(at))
            w = split_words(raw, offs, ALNUM_WORD)
            keys = w.dictionary.to_numpy(zero_copy_only=False).tolist()
            start = w.row_start
            spans: list[list] = [[] for _ in range(b.num_rows)]
            number = np.fromiter((s.words.get(k, 0) for k in keys), np.int64, len(keys))
            for p, n, r in s.scan(number[w.ids] if len(w.ids) else np.zeros(0, np.int64), w.counts):
                row = int(np.searchsorted(start, p, side="right")) - 1
                last = p + n - 1
                end = int(w.starts[last]) + len(keys[w.ids[last]])
                spans[row].append({"first": p - int(start[row]), "last": last - int(start[row]), "from": int(w.starts[p] - offs[row]), "to": int(end - offs[row]), "items": [s.items[k] for k in s.by_length[n][2][r]]})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w.counts.astype(np.int64)), pa.array(spans, span_type)], names=[*kept, *names])

    return src.mapInArrow(run, schema)


def contamination(df: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts words inside any occurrence; ``items_sha256`` is of the sorted
    item ids as strings, comma-joined (of the empty string without hits).  Windows of items
    with a null id count like others; ``n_items`` has all null ids as one, ``items_sha256`` none.
    Null and empty texts have no words and no hit; every row has one result, repeated rows equal ones;
    items of one id are one item.
    """
    text = options.get("text", "text")
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias(text) if text != "doc_id" else F.col("`doc_id`"))
    spans = find_spans(src, benchmark, **options).select("doc_id", "_n_words", "_spans")
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_spans", lambda s: s["items"]))))
    # spans sorted by first word: each adds the words that none before it has
    hit = F.expr("aggregate(array_sort(transform(_spans, s -> struct(s.first AS first, s.last AS last))), struct(0L AS n, -1L AS upto), (a, s) -> struct(a.n + greatest(0L, s.last - greatest(s.first - 1, a.upto)) AS n, greatest(a.upto, s.last) AS upto), a -> a.n)")
    out = spans.select("doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(df: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text: str = "text", max_share: float = 0.0, **options) -> DataFrame:
    """Remove what repeats the benchmark; the columns of ``df`` stay.

    ``mode="documents"`` drops rows whose hit words exceed ``max_share`` of their words;
    ``mode="spans"`` cuts the hit passages out of the text and keeps every row.
    """
    n_words, spans = free_name(df.columns, "_n_words"), free_name(df.columns, "_spans")
    found = find_spans(df, benchmark, text=text, names=(n_words, spans), **options)
    columns = [F.col(f"`{c}`") for c in df.columns]
    if mode == "documents":
        hit = F.expr(f"aggregate(array_sort(transform({spans}, s -> struct(s.first AS first, s.last AS last))), struct(0L AS n, -1L AS upto), (a, s) -> struct(a.n + greatest(0L, s.last - greatest(s.first - 1, a.upto)) AS n, greatest(a.upto, s.last) AS upto), a -> a.n)")
        return found.where(hit <= F.lit(max_share) * F.col(n_words)).select(*columns)
    if mode != "spans":
        raise ValueError(mode)
    # kept byte ranges: what lies between the ends of the spans so far and the next one
    raw = f"encode(`{text}`, 'UTF-8')"
    cut = F.expr(
        f"aggregate(array_sort(transform({spans}, s -> struct(s.from AS a, s.to AS b))), struct(cast('' AS binary) AS kept, 0L AS at), "
        f"(x, s) -> struct(CASE WHEN s.a > x.at THEN concat(x.kept, substring({raw}, cast(x.at + 1 AS int), cast(s.a - x.at AS int))) ELSE x.kept END AS kept, greatest(x.at, s.b) AS at), "
        f"x -> decode(concat(x.kept, substring({raw}, cast(x.at + 1 AS int))), 'UTF-8'))"
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(f"`{text}`"))).select(*columns)
