"""Quality rules: document statistics and monotonic gradient-boosted trees over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import gbt
from quern.llm.shared import Workspace
from quern.llm.text import SPACE_WORD, encode_runs, mix64, row_sums, slices, split_words, table, utf8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_same_words")
#: (feature, direction in which quality may go as it grows; 0: free)
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("same_word_share", -1),
    ("upper_share", -1), ("digit_share", -1), ("mark_share", -1), ("distinct_share", 1), ("words_per_line", 0),
)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
MARK = table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Labelled rows the trees are fitted on, at most.
TRAIN_ROWS = 20_000


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` and ``EXTRA`` of each row; null texts count 0 everywhere.

    A repeated word lies in a 3-word window that the text has twice or more; a
    duplicate line has a word and equals an earlier line of its text.
    """
    raw, offs = utf8(column)
    n = len(offs) - 1
    word = SPACE_WORD[raw]
    w = split_words(raw, offs, lower=False)
    rows, counts = w.rows, w.counts
    out = {"n_words": counts.astype(np.int64), "word_chars": row_sums(word & ((raw & 0xC0) != 0x80), offs), "n_symbols": row_sums(SYMBOLS[raw], offs)}
    # lines: rows are cut at line feeds; a line's bytes go with its row's number into one comparison
    feed = raw == 0x0A
    start = np.zeros(len(raw) + 1, bool)
    start[1:][feed] = True
    start[offs[:-1]] = True
    start[-1] = False
    at = np.flatnonzero(start)
    line_row = np.searchsorted(offs, at, side="right") - 1
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(word, out=total[1:])
    ends = np.append(at[1:], len(raw))
    some = total[ends] > total[at]
    # the feed that ends a line belongs to its run here; it is left out of the comparison
    stop = ends - np.where((ends > at) & (raw[np.maximum(ends - 1, 0)] == 0x0A), 1, 0) if len(raw) else ends
    keep = np.ones(len(raw), bool)
    keep[stop[stop < ends]] = False
    ids, _ = encode_runs(raw[keep], at, stop - at)
    key = line_row[some].astype(np.int64) << 32 | ids[some]
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    again = np.ones(len(key), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(line_row[some][again], minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(line_row[some], minlength=n).astype(np.int64)
    # 3-word windows: numbered exactly, first pairs, then pair and word, then with the row
    ids = w.ids.astype(np.int64)
    mark = np.zeros(len(ids), bool)
    if len(ids) >= 3:
        inside = rows[:-2] == rows[2:]
        at3 = np.flatnonzero(inside)
        pair = np.unique(ids[at3] << 32 | ids[at3 + 1], return_inverse=True)[1]
        three = np.unique(pair << 32 | ids[at3 + 2], return_inverse=True)[1]
        _, inv, c = np.unique(rows[at3].astype(np.int64) << 32 | three, return_inverse=True, return_counts=True)
        hit = at3[c[inv] > 1]
        for k in range(3):
            mark[hit + k] = True
    out["n_repeat_words"] = np.bincount(rows[mark], minlength=n).astype(np.int64)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1])
    out["n_same_words"] = np.bincount(rows[same], minlength=n).astype(np.int64)
    out["n_distinct"] = np.bincount((np.unique(rows.astype(np.int64) << 32 | ids) >> 32), minlength=n).astype(np.int64)
    upper = table((0x41, 0x5A))[raw]
    out["n_upper"] = row_sums(upper, offs)
    out["n_letters"] = row_sums(upper | table((0x61, 0x7A), (0xC0, 0xFF))[raw], offs)
    out["n_digits"] = row_sums(table((0x30, 0x39))[raw], offs)
    out["n_marks"] = row_sums(MARK[raw], offs)
    return out


def document_statistics(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``COUNTS`` and ``EXTRA`` as longs; one narrow pass."""
    made = (*COUNTS, *EXTRA)
    kept = [c for c in df.columns if c not in made]
    src = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    schema = src.drop(text).withColumns({c: F.lit(0).cast("long") for c in made}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            got = text_counts(b.column(at))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), *(pa.array(got[c]) for c in made)], names=[*(c for c in kept if c != text), *made])

    return src.mapInArrow(run, schema)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The matrix of ``FEATURES`` from the counts."""
    w, chars = np.maximum(c["n_words"], 1).astype(float), np.maximum(c["word_chars"], 1).astype(float)
    lines = np.maximum(c["n_lines"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / w, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / w, c["n_same_words"] / w, c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_digits"] / chars, c["n_marks"] / chars, c["n_distinct"] / w, w / lines], 1)


def fit_quality(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> gbt.Forest:
    """Trees from at most ``rows`` labelled documents, those with the lowest md5 of their id."""
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").orderBy(order, "y").limit(rows)
    names = [*COUNTS, *EXTRA]
    got = stats.select(F.col(f"`{doc_id}`").alias("doc_id"), *names).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").limit(rows).toPandas()
    x = features({c: got[c].to_numpy() for c in names})
    return gbt.fit(x, got["y"].to_numpy(float), monotone={i: s for i, (_, s) in enumerate(FEATURES) if s})


def quality_rules(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5, work_dir: str | None = None) -> DataFrame:
    """Per row: doc_id, ``COUNTS``, base_failed, kept, quality_score.

    ``base_failed``: fewer than 50 words, or more than half of them repeated.  Otherwise a
    row is kept if the trees give it at least ``threshold``.  Without labels of both
    kinds the trees are a constant that keeps everything the base keeps.
    """
    ws = Workspace(df.sparkSession, "quality", work_dir)
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stats = ws.keep(document_statistics(src), "stats")
    forest = fit_quality(stats, labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("y")), label="y")
    constant = not len(forest.roots)
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_numpy() for n in (*COUNTS, *EXTRA)}
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            score = np.ones(b.num_rows) if constant else forest.score(features(c))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c[n]) for n in COUNTS), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "quality_score"])

    return stats.mapInArrow(run, f"doc_id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, quality_score double")
