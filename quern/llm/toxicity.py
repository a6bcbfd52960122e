"""Toxic passages as maximum-scoring segments of token log-odds.

Learning.  Tokens are lower-case words and their byte prefixes.  A unit's odds ratio has a
Dirichlet prior whose pseudo-counts follow its parent (the next shorter prefix, at last
the whole corpus), so a word never seen scores like its longest known prefix.  Only
units whose log-odds differ from their parent's by ``EFFECT`` are stored.

Scoring.  Every token adds its log-odds less a small drift; a linear scan (Ruzzo and
Tompa) gives all maximal segments.  Segments of non-toxic texts that were kept out of the
counts fit the tail of an extreme-value law, E(s) = K n exp(-lambda s); a text's best
segment and the sum of its significant ones, both on that scale, go through a logistic
curve fitted on the same kept-out texts.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import Workspace, n_rows
from quern.llm.text import ALNUM_WORD, SMALL_SLICE, Words, mix64, slices, split_words, utf8, word_hashes

#: Labelled rows that are learned from, at most (those with the lowest md5 of their id).
TRAIN_ROWS = 200_000
PREFIXES = (3, 4, 5, 6)
STRENGTH, EFFECT, DRIFT = 3, 1.5, .1
SHARDS = 256
#: Units (40 bytes each) that a worker counts before it merges them, and merged ones before it sends them.
MERGE_UNITS = 400_000
#: Stored units that a broadcast may hold (16 bytes each); beyond, workers map them from the shared folder.
MOST_UNITS = 4_000_000


def unit_hashes(dictionary: pa.Array) -> np.ndarray:
    """(levels, words): hash of each word's prefixes, shortest first, and of the word.

    A prefix that is the whole word or longer has hash 0: the word itself stands for it.
    """
    n = len(dictionary)
    offs = np.frombuffer(dictionary.buffers()[1], np.int64, n + 1 + dictionary.offset)[dictionary.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(dictionary.buffers()[2], np.uint8) if n and dictionary.buffers()[2] is not None else np.zeros(1, np.uint8)
    lens = np.diff(offs)
    out = np.zeros((len(PREFIXES) + 1, n), np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(max(PREFIXES)):
        byte = raw[np.minimum(offs[:-1] + k, len(raw) - 1)].astype(np.uint64)
        acc |= np.where(k < lens, byte << np.uint64(8 * k), np.uint64(0))
        if k + 1 in PREFIXES:
            out[PREFIXES.index(k + 1)] = np.where(lens > k + 1, mix64(acc | np.uint64(k + 1) << np.uint64(56)) | np.uint64(1), np.uint64(0))
    out[-1] = word_hashes(dictionary) | np.uint64(1)
    return out


UNIT = np.dtype([("h", "<u8"), ("up", "<u8"), ("level", "<i8"), ("y1", "<i8"), ("y0", "<i8")])


def _merge(parts: list[np.ndarray]) -> np.ndarray:
    a = np.concatenate(parts)
    parts.clear()
    a = a[np.argsort(a["h"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], a["h"][1:] != a["h"][:-1]])) if len(a) else np.zeros(0, np.int64)
    out = a[first].copy()
    for c in ("y1", "y0"):
        out[c] = np.add.reduceat(a[c], first) if len(a) else 0
    return out


def _units(w: Words, toxic: np.ndarray) -> np.ndarray:
    """Texts of each label that have a unit, for all units of a slice.

    Texts are counted, not tokens: one text that repeats a word says no more than once.
    """
    hashes = unit_hashes(w.dictionary)
    rows = w.rows.astype(np.int64) << 32
    up, parts = np.zeros(hashes.shape[1], np.uint64), []
    for level, h in enumerate(hashes):
        distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
        pair = np.unique(rows | number[w.ids]) if len(w.ids) else np.zeros(0, np.int64)
        of, unit = toxic[pair >> 32], pair & 0xFFFFFFFF
        a = np.zeros(len(distinct), UNIT)
        a["h"], a["up"], a["level"] = distinct, up[first], level
        a["y1"], a["y0"] = np.bincount(unit[of], minlength=len(distinct)), np.bincount(unit[~of], minlength=len(distinct))
        parts.append(a[distinct != 0])
        up = np.where(h != 0, h, up)
    return np.concatenate(parts)


def count_units(df: DataFrame) -> DataFrame:
    """(shard, blob) of ``df(text, y)``; a unit and all its longer forms share a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush(all_units: np.ndarray):
            # shard: that of the shortest form, so parents meet their children
            order = np.argsort(all_units["h"])
            top = all_units["h"].copy()
            up = all_units["up"].copy()
            for _ in range(len(PREFIXES) + 1):
                some = np.flatnonzero(up != 0)
                if not len(some):
                    break
                at = order[np.searchsorted(all_units["h"][order], up[some])]
                top[some] = up[some]
                up[some] = all_units["up"][at]
            shard = (top >> np.uint64(56)).astype(np.int64) % SHARDS
            by = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[by], np.arange(SHARDS + 1))
            rows = [(s, zstandard.compress(all_units[by[cut[s] : cut[s + 1]]].tobytes(), 1)) for s in range(SHARDS) if cut[s + 1] > cut[s]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

        for b in slices(batches, "text", SMALL_SLICE):
            raw, offs = utf8(b.column(0))
            u = _units(split_words(raw, offs, ALNUM_WORD), b.column(1).to_numpy(zero_copy_only=False) == 1)
            held.append(u)
            size += len(u)
            if size > MERGE_UNITS:  # merged as they come: a worker never holds two or three times what it sends
                held = [_merge(held)]
                size = 0
                if len(held[0]) > MERGE_UNITS:
                    yield flush(held.pop())
        if size or held:
            yield flush(_merge(held))

    return df.select("text", "y").mapInArrow(run, "shard int, blob binary")


def log_odds(units: DataFrame, n1: int, n0: int) -> DataFrame:
    """(h, score) of the units that say more than their parents; n1 and n0: texts of each label."""
    share = n1 / max(1, n0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                groups.setdefault(s, []).append(np.frombuffer(zstandard.decompress(x), UNIT))
        for parts in groups.values():
            a = _merge(parts)
            ratio, kept = np.ones(len(a)), np.ones(len(a))
            for level in range(len(PREFIXES) + 1):
                at = np.flatnonzero(a["level"] == level)
                up = a["up"][at]
                p = np.minimum(np.searchsorted(a["h"], up), len(a) - 1)
                parent = np.where(up != 0, ratio[p], 1.0)
                shown = np.where(up != 0, kept[p], 1.0)
                ratio[at] = (a["y1"][at] + STRENGTH * parent) / (a["y0"][at] * share + STRENGTH)
                # a unit that is not stored scores as its nearest stored parent
                far = np.abs(np.log(ratio[at]) - np.log(shown)) >= EFFECT
                kept[at] = np.where(far, ratio[at], shown)
                yield pa.RecordBatch.from_arrays([pa.array(a["h"][at][far].view(np.int64)), pa.array(np.log(ratio[at][far]))], names=["h", "score"])

    return units.mapInArrow(run, "h long, score double")


@dataclass
class ToxicModel:
    """Stored units (sorted hashes, log-odds), the tail law, and the logistic curve."""

    hashes: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    level: float = 1.0
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def token_scores(self, w: Words) -> np.ndarray:
        """Log-odds of each dictionary entry, less the drift."""
        units = unit_hashes(w.dictionary)
        out = np.zeros(units.shape[1])
        if len(self.hashes):
            for h in units:  # longer forms overrule shorter ones
                p = np.minimum(np.searchsorted(np.asarray(self.hashes), h), len(self.hashes) - 1)
                out = np.where(self.hashes[p] == h, self.scores[p], out)
        return out - DRIFT

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """(best segment, sum of significant segments), as -log E of the tail law."""
        floor = math.log(self.level * max(n, 1))
        bits = [self.rate * s - floor for _, _, s in segments]
        return max([*bits, -floor]), math.log1p(sum(x for x in bits if x > 0))

    def probability(self, best: float, total: float) -> float:
        z = self.curve[0] + self.curve[1] * best + self.curve[2] * total
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in linear time.

    Only positive places start work; what lies between them is in the running sums.  Every
    segment knows the nearest one before it with a smaller sum before: the search for the
    segment that a new one joins goes along these links, and what it passes is never met again.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    begin, end, before, after, link = [], [], [], [], []
    some = np.flatnonzero(scores > 0)
    for i, lo, hi in zip(some.tolist(), total[some].tolist(), total[some + 1].tolist()):
        first, j = i, len(begin) - 1
        while j >= 0 and before[j] >= lo:
            j = link[j]
        while j >= 0 and after[j] < hi:  # joined: all from there on are one, whose link is known
            first, lo, up = begin[j], before[j], link[j]
            del begin[j:], end[j:], before[j:], after[j:], link[j:]
            j = up
        for x, v in ((begin, first), (end, i), (before, lo), (after, hi), (link, j)):
            x.append(v)
    return [(a, b, z - y) for a, b, y, z in zip(begin, end, before, after)]


def _scan(model: ToxicModel, column: pa.Array):
    """(row, number of tokens, segments, byte ranges) of each row of a slice."""
    raw, offs = utf8(column)
    w = split_words(raw, offs, ALNUM_WORD)
    per_word = model.token_scores(w)
    scores, start = per_word[w.ids] if len(w.ids) else np.zeros(0), w.row_start
    hot = np.bincount(w.rows[scores > 0], minlength=len(w.counts)) if len(scores) else np.zeros(len(w.counts))
    for r in range(len(w.counts)):
        yield r, int(w.counts[r]), maximal_segments(scores[start[r] : start[r + 1]]) if hot[r] else [], w, int(start[r]), int(offs[r])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit_toxicity(df: DataFrame, labels: DataFrame, ws: Workspace, *, rows: int = TRAIN_ROWS) -> ToxicModel:
    """Learn from ``df(doc_id, text)`` and ``labels(doc_id, y)``; folds 1 to 3 count, fold 4 calibrates, fold 0 is never seen."""
    chosen = labels.where("y IN (0, 1) AND doc_id IS NOT NULL").withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    chosen = ws.keep(chosen.groupBy("doc_id", "fold").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(rows), "labelled")
    texts = df.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", "fold")
    blobs = ws.keep(count_units(texts.where("fold < 4")), "units")
    empty = ToxicModel(np.zeros(0, np.uint64), np.zeros(0))
    texts_of = {r["y"]: r["count"] for r in chosen.where("fold < 4").groupBy("y").count().collect()}
    n1, n0 = texts_of.get(1, 0), texts_of.get(0, 0)
    if not n1 or not n0:
        return empty
    n_out = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    stored = ws.keep(log_odds(blobs.repartition(n_out, "shard"), n1, n0), "log-odds")
    if n_rows(stored) > MOST_UNITS:
        model = ToxicModel(*_mapped(stored, ws))
    else:
        got = stored.toPandas()
        h = got["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        model = ToxicModel(h[order], got["score"].to_numpy(float)[order])
    sent = ws.spark.sparkContext.broadcast(model)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SMALL_SLICE):
            y = b.column("y").to_pylist()
            seen = [(y[r], n, [s for _, _, s in seg]) for r, n, seg, *_ in _scan(sent.value, b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.int32()), pa.array([x[1] for x in seen], pa.int64()), pa.array([x[2] for x in seen], pa.list_(pa.float64()))], names=["y", "n", "segments"])

    held_out = texts.where("fold = 4").select("text", F.col("y").cast("int").alias("y")).mapInArrow(observe, "y int, n long, segments array<double>")
    return _calibrate(model, ws.keep(held_out, "held-out"))


def _mapped(stored: DataFrame, ws: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, scores) as arrays mapped from two files, written in order a piece at a time."""
    folder = ws.folder("mapped")
    paths = [os.path.join(folder, x) for x in ("hashes", "scores")]
    with open(paths[0], "wb") as hashes, open(paths[1], "wb") as scores:
        # unsigned order; a partition at a time passes through the driver
        for r in stored.select((F.col("h").bitwiseXOR(F.lit(-(2**63)))).alias("at"), "h", "score").orderBy("at").select("h", "score").toLocalIterator(prefetchPartitions=False):
            hashes.write(struct.pack("<q", r.h))
            scores.write(struct.pack("<d", r.score))
    return MappedArray(paths[0], "<u8"), MappedArray(paths[1], "<f8")


class MappedArray:
    """A file of numbers that travels by its path and is mapped where it is used."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def __array__(self, dtype=None, copy=None):
        return self.values()

    def values(self) -> np.ndarray:
        if "_held" not in self.__dict__:
            self._held = np.memmap(self.path, self.kind, "r")
        return self._held

    def __getstate__(self):
        return {"path": self.path, "kind": self.kind}

    def __len__(self) -> int:
        return os.path.getsize(self.path) // 8

    def __getitem__(self, at):
        return self.values()[at]


def _calibrate(model: ToxicModel, held_out: DataFrame) -> ToxicModel:
    """Tail law from non-toxic texts' segments over their median, then Newton's method for the curve.

    ``held_out(y, n, segments)`` is summed up in Spark; three numbers a calibration text
    (at most the bound on labelled rows) come to the driver.
    """
    kinds = held_out.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if kinds.lo is None or kinds.lo == kinds.hi:
        return model
    clean = held_out.where("y = 0")
    tokens = clean.agg(F.sum("n")).first()[0]
    scores = clean.select(F.explode("segments").alias("s"))
    found = scores.agg(F.count("*").alias("n"), F.percentile_approx("s", 0.5, 100_000).alias("half")).first()
    if found.n >= 20:
        over = scores.where(F.col("s") > found.half).agg(F.count("*").alias("n"), F.avg(F.col("s") - found.half).alias("mean")).first()
        model.rate = float(np.clip(1 / max(over["mean"], 1e-6), 0.2, 5)) if over.n else 1.0
        model.level = float(max(over.n, 1) * math.exp(model.rate * found.half) / max(tokens, 1))
    else:  # log-odds scores have rate 1 by themselves
        model.level = max(found.n, 1) / max(tokens, 1)
    floor = F.log(F.lit(model.level) * F.greatest("n", F.lit(1)))
    best = F.greatest(model.rate * F.coalesce(F.array_max("segments"), F.lit(0.0)) - floor, -floor)
    total = F.log1p(F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.greatest(model.rate * s - floor, F.lit(0.0))))
    seen = held_out.select(F.col("y").cast("double").alias("y"), best.alias("best"), total.alias("total")).toPandas()
    y = seen["y"].to_numpy()
    x = np.nan_to_num(np.column_stack([np.ones(len(seen)), seen["best"], seen["total"]]))
    center, scale = np.array([0, *x[:, 1:].mean(0)]), np.array([1, *np.maximum(x[:, 1:].std(0), 1e-6)])
    z, beta = (x - center) / scale, np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - np.array([0, 0.1, 0.1]) * beta
        hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag([1e-9, 0.1, 0.1])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w = beta / scale
    model.curve = (float(beta[0] - (w[1:] * center[1:]).sum()), float(w[1]), float(w[2]))
    return model


PASSAGES = "array<struct<from:bigint,to:bigint,score:double,evidence:double>>"


def score_toxicity(df: DataFrame, model: ToxicModel, *, text: str = "text", names: tuple[str, str] = ("_score", "_passages")) -> DataFrame:
    """``df`` with a score (0 to 1) and passages: byte ranges of every significant segment.

    ``names``: the two new columns; ``df`` must not have them.  Null and empty texts have no
    segment and get the lowest score.
    """
    if set(names) & set(df.columns):
        raise ValueError(f"columns {names} are taken: pass other names")
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = df.columns
    at = kept.index(text)
    src = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = src.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(None).cast(PASSAGES)}).schema
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches, text, SMALL_SLICE):
            score, passages = [], []
            lens = None
            for _, n, seg, w, first, base in _scan(m, b.column(at)):
                if lens is None:
                    lens = np.asarray(pa.compute.binary_length(w.dictionary))
                score.append(m.probability(*m.evidence(seg, n)))
                floor = math.log(m.level * max(n, 1))
                passages.append([{"from": int(w.starts[first + i]) - base, "to": int(w.starts[first + j] + lens[w.ids[first + j]]) - base, "score": s, "evidence": m.rate * s - floor} for i, j, s in seg if m.rate * s > floor])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array(passages, kind)], names=[*kept, *names])

    return src.mapInArrow(run, schema)


def toxicity(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, work_dir: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, passages.

    Labels of rows whose fold (crc32 of the id as text modulo 5) is 0 are never read.
    Without labels of both kinds every score is close to 0.  Of several labels of one id the
    largest counts; labels without an id, or other than 0 and 1, do not.  Null and empty texts
    have no passage and the lowest score; every row has one result, repeated rows equal ones.
    """
    ws = Workspace(df.sparkSession, "toxicity", work_dir)
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    model = fit_toxicity(src, labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")), ws, rows=rows)
    got = score_toxicity(src, model)
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_passages").alias("passages"))
