"""Repeated passages: MinHash banding over paragraphs, and the passages inside them.

A paragraph is a line of at least ``least`` words.

1. Every paragraph's 5-word shingles give a MinHash signature, cut into bands (``tune_bands``).
   Packed counts of the band keys tell which occur twice or more in the corpus.
2. Paragraphs with such a key are written out; equal ones form a class.  Classes that share
   a key are linked if the exact Jaccard similarity reaches the threshold (see ``linking``);
   links form components, and of a component all but its first occurrence are repeats.

A passage inside a paragraph, or across several, has no such borders.  It is found by anchors:

3. A text is also cut by what it says: a word begins an anchor where the hash of it and its
   successor is lowest among its neighbours, about every nine words, so a passage falls into
   the same anchors wherever it is copied to.  Anchors that several texts have are laid beside
   their first occurrence; neighbours on both sides form segments, segments form chains.
4. The words before, between and behind the segments of a chain, and only they, are fetched
   and compared: equal words are followed to their true ends, and segments are joined over an
   edit where the joined passages' 5-word shingles, place by place, reach the threshold.
5. What is repeated and touches forms runs.  In runs of at least ``least`` words all but the
   first occurrence is removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.linking import link_lists
from quern.llm.often import OftenKeys, count_often
from quern.llm.shared import Workspace, free_name, settle, small
from quern.llm.text import SMALL_SLICE, mix64, ragged_take, shingle_hashes, slices, split_words, utf8

REACH = 4
SHINGLE = 5
#: Words of a repeated run that is worth removing, and of a line that is a paragraph.
LEAST_WORDS = 50
#: A gap that any chain of anchors may have: an edit takes the anchor it is in and its neighbours.
WIDE = 64
#: Words before a segment, between two, and behind one.
BEFORE, BETWEEN, BEHIND = -1, 0, 1


def tune_bands(threshold: float, rows: int = 2, recall: float = 0.995) -> int:
    """Fewest bands of ``rows`` values that a pair at the threshold shares with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def cut_paragraphs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each anchor, row of each) for word hashes row after row.

    No anchor has fewer than REACH + 1 words, but those of short rows and those next to
    a long run of one word.
    """
    n = len(words)
    begin = np.cumsum(counts) - counts
    first = np.zeros(n + 1, bool)
    first[begin[counts > 0]] = True
    if n > 2 * REACH + 2:
        with np.errstate(over="ignore"):
            g = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
        g = np.append(g, np.uint64(2**64 - 1))
        low = np.ones(n, bool)
        for k in range(1, REACH + 1):
            low[k:] &= g[k:] < g[:-k]
            low[:-k] &= g[:-k] <= g[k:]
        place = np.arange(n) - np.repeat(begin, counts)
        left = np.repeat(counts, counts) - place
        first[:-1] |= low & (place > REACH) & (left > REACH)
        # one word over and over has no lowest place: such a run is an anchor of its own
        same = np.zeros(n + 1, bool)
        same[1:n] = (words[1:] == words[:-1]) & (place[1:] > 0)
        edge = np.flatnonzero(~same)
        long = np.diff(edge) > 2 * REACH + 2
        first[edge[:-1][long]] = True
        first[edge[1:][long]] = True
    start = np.flatnonzero(first[:-1])
    return start, np.searchsorted(np.cumsum(counts), start, side="right")


def signature_keys(hashes: np.ndarray, per: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) of keys from the shingle hashes of each paragraph."""
    start = np.cumsum(per) - per
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(per), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            acc = np.full(len(per), np.uint64(b + 1))
            for r in range(rows):
                f = factors[b * rows + r]
                acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * f + (f >> np.uint64(17)), start))
            out[:, b] = acc
    return out


def names(words: np.ndarray, lengths: np.ndarray, salt: int) -> np.ndarray:
    """128-bit hash of each run of words that fill ``words``, as (n, 2)."""
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(at, lengths).astype(np.uint64) + np.uint64(salt)
    with np.errstate(over="ignore"):
        both = [np.add.reduceat(mix64(words + place * np.uint64(k)), at) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
    return np.stack(both, 1)


class Cut:
    """Paragraphs and anchors of a slice: place, length, row, name and keys of each."""

    def __init__(self, column: pa.Array, least: int, bands: int, rows: int):
        raw, offs = utf8(column)
        w = split_words(raw, offs)
        words, row_start = (w.hashes()[w.ids] if len(w.ids) else np.zeros(0, np.uint64)), w.row_start
        self.counts = w.counts
        self.a_at, self.a_row = cut_paragraphs(words, w.counts)
        self.a_len = np.diff(np.append(self.a_at, len(words)))
        self.a_start = self.a_at - row_start[self.a_row]
        self.a_names = names(words, self.a_len, 1) if len(words) else np.zeros((0, 2), np.uint64)
        # a long run of one word has the shingles of any other, whatever its length
        long = np.flatnonzero(self.a_len > 2 * REACH + 2)
        if len(long):
            inside, n = ragged_take(words, np.append(self.a_at, len(words)), long)
            head = np.cumsum(n) - n
            same = long[np.add.reduceat((inside != np.repeat(inside[head], n)).astype(np.int64), head) == 0]
            if len(same):
                self.a_names[same] = names(words[self.a_at[same]], np.ones(len(same), np.int64), 1 << 41)
        line = np.searchsorted(np.flatnonzero(raw == 10), w.starts)
        first = np.ones(len(words), bool)
        first[1:] = line[1:] != line[:-1]
        first[row_start[:-1][w.counts > 0]] = True
        at = np.flatnonzero(first)
        offs = np.append(at, len(words))
        long = np.flatnonzero(np.diff(offs) >= least)
        inside, self.p_len = ragged_take(words, offs, long)
        self.p_row = np.searchsorted(row_start[1:], at[long], side="right")
        self.p_start = at[long] - row_start[self.p_row]
        self.p_names = names(inside, self.p_len, 1 << 40) if len(inside) else np.zeros((0, 2), np.uint64)
        self.hashes, self.per = shingle_hashes(inside, self.p_len, SHINGLE)
        self.p_keys = signature_keys(self.hashes, self.per, bands, rows) if len(long) else np.zeros((0, bands), np.uint64)

    @property
    def a_keys(self) -> np.ndarray:
        return mix64(self.a_names[:, 0])


FOUND = "row long, start long, n_words long, n_text long, c binary, set array<bigint>"


def candidates(src: DataFrame, ws: Workspace, least: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, start, n_words, n_text, c, set) of the paragraphs and anchors with a repeated key.

    n_text: words of the whole text; set: shingles of a paragraph, null for anchors and where
    the task has told them before; c: name, one byte longer for a paragraph.
    """

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in slices(batches, "text", SMALL_SLICE):
            p = Cut(b.column(2), least, bands, rows)
            yield np.concatenate([p.p_keys.ravel(), p.a_keys])

    folder = count_often(src, keys_of, ws, "often")
    id_type = src.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = OftenKeys(folder)
        told: set[bytes] = set()
        for b in slices(batches, "text", SMALL_SLICE):
            p = Cut(b.column(2), least, bands, rows)
            par = np.flatnonzero(often.has(p.p_keys.ravel()).reshape(-1, bands).any(1))
            anc = np.flatnonzero(often.has(p.a_keys))
            begin, name, sets = np.cumsum(p.per) - p.per, [], []
            for i in par.tolist():
                name.append(p.p_names[i].tobytes() + b"p")
                sets.append(None if name[-1] in told else np.unique(p.hashes[begin[i] : begin[i] + p.per[i]]).view(np.int64))
                told.add(name[-1])
            if len(told) > 100_000:
                told = set()
            raw = np.ascontiguousarray(p.a_names[anc]).tobytes()
            name += [raw[k : k + 16] for k in range(0, len(raw), 16)]
            if not name:
                continue
            which = np.concatenate([p.p_row[par], p.a_row[anc]])
            numbers = [np.concatenate(x).astype(np.int64) for x in ((p.p_start[par], p.a_start[anc]), (p.p_len[par], p.a_len[anc]))]
            at = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), *[pa.array(x) for x in numbers], pa.array(p.counts[which].astype(np.int64)), pa.array(name, pa.binary()), pa.array(sets + [None] * len(anc), pa.list_(pa.int64()))],
                names=["doc_id", "row", "start", "n_words", "n_text", "c", "set"],
            )

    found = ws.keep(src.mapInArrow(emit, f"doc_id {id_type}, {FOUND}"), "occurrences")
    ws.free("often")
    return found


PLACE = ("doc_id", "row", "start", "n_text", "n_words")


def _whole(named: DataFrame, by: str) -> DataFrame:
    """(by, lo, n) of what more than one text has; lo: its first place."""
    whole = named.groupBy(by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return whole.where(~F.struct("lo.doc_id", "lo.row").eqNullSafe(F.col("hi"))).select(by, "lo", "n")


def repeated_paragraphs(found: DataFrame, ws: Workspace, *, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """Paragraphs among ``candidates`` whose component more than one text has.

    Columns: doc_id, row, start, n_words, n_text, n (occurrences), lo (place of the first).
    """
    mine = found.where("length(c) > 16")
    classes = mine.groupBy("c").agg(F.min(F.struct(*PLACE)).alias("lo"), F.max(F.struct("doc_id", "row")).alias("hi"), F.count("*").alias("n"), F.first("set", ignorenulls=True).alias("set"))
    # a class of one occurrence met a repeated key by another's likeness: it stays for the links
    classes = ws.keep(classes, "classes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("set")
            per = np.diff(lists.offsets.to_numpy().astype(np.int64))
            if not len(per):
                continue
            keys = signature_keys(lists.flatten().to_numpy().view(np.uint64), per, bands, rows)
            who = pa.array(np.repeat(np.arange(len(per)), bands))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column("c").take(who), pa.array(per.astype(np.int32)).take(who)], names=["key", "c", "n"])

    lists = classes.select("c", "set").mapInArrow(keyed, "key long, c binary, n int")
    comps = link_lists(lists, lambda need, name: classes.select("c", "set").join(small(need), "c", "left_semi"), ws, num=num, den=den)
    named = classes.select("c", "lo", "hi", "n").join(small(comps), "c", "left").withColumn("root", F.coalesce("root", "c"))
    info = ws.keep(named.select("c", "root").join(_whole(named, "root"), "root").select("c", "lo", "n"), "info")
    return mine.drop("set").join(small(info), "c").drop("c")


def repeated_anchors(found: DataFrame, ws: Workspace) -> DataFrame:
    """Anchors among ``candidates`` that more than one text has; the columns are those of paragraphs."""
    mine = found.where("length(c) = 16").drop("set")
    info = _whole(mine.groupBy("c").agg(F.min(F.struct(*PLACE)).alias("lo"), F.max(F.struct("doc_id", "row")).alias("hi"), F.count("*").alias("n")), "c")
    return mine.join(small(ws.keep(info, "anchor-info")), "c").drop("c")


def equal_stretches(x: np.ndarray, y: np.ndarray, side: int) -> list[tuple[int, int, int]]:
    """(place in x, place in y, words) of what is equal in the words beside or between segments.

    Equal words are followed from the segments; between two, any SHINGLE equal words at the
    shift of either count as well.
    """
    n = min(len(x), len(y))
    if side == BEFORE:
        k = int(np.argmin(np.append(x[len(x) - n :][::-1] == y[len(y) - n :][::-1], False)))
        return [(len(x) - k, len(y) - k, k)] if k else []
    if side == BEHIND:
        k = int(np.argmin(np.append(x[:n] == y[:n], False)))
        return [(0, 0, k)] if k else []
    out = []
    for sx, sy in {(0, 0), (len(x) - n, len(y) - n)}:
        edge = np.diff(np.concatenate([[0], (x[sx : sx + n] == y[sy : sy + n]).view(np.int8), [0]]))
        for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if z - a >= SHINGLE or (sx + a == 0 == sy + a) or (sx + z == len(x) and sy + z == len(y)):
                out.append((sx + a, sy + a, z - a))
    return out


def join_parts(found: list[tuple[int, int, int]], num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(start, end in a, start, end in b) of passages from equal stretches (place in a, in b, words).

    Stretches are joined, the longest passages first from the left, where the shingles inside
    them are num / den of all that both passages have.
    """
    parts: list[list[int]] = []
    for x, y, n in sorted(found):
        if parts and y - x == parts[-1][2] - parts[-1][0] and x <= parts[-1][1]:  # goes on at the same shift
            grow = max(0, x + n - parts[-1][1])
            parts[-1][1] += grow
            parts[-1][3] += grow
            continue
        lost = max(0, parts[-1][1] - x, parts[-1][3] - y) if parts else 0
        if n > lost:
            parts.append([x + lost, x + n, y + lost, y + n])
    parts = [p for p in parts if p[1] - p[0] >= SHINGLE]
    inside = np.cumsum([0] + [p[1] - p[0] - SHINGLE + 1 for p in parts])
    ends = np.array([(p[1], p[3]) for p in parts], np.int64).reshape(-1, 2)
    out, i = [], 0
    while i < len(parts):
        both = inside[i + 1 :] - inside[i]
        every = (ends[i:, 0] - parts[i][0]) + (ends[i:, 1] - parts[i][2]) - 2 * (SHINGLE - 1) - both
        j = i + int(np.flatnonzero(den * both >= num * every)[-1])
        out.append((parts[i][0], parts[j][1], parts[i][2], parts[j][3]))
        i = j + 1
    return out


def whole_passages(anchors: DataFrame, src: DataFrame, ws: Workspace, num: int, den: int) -> DataFrame:
    """Passages (doc_id, row, start, n_words, class_id, n_occurrences, first) about ``repeated_anchors``.

    Anchors of one text whose first occurrences are in one other text form a chain; a gap
    wider than half of them together cannot lie inside a passage above the threshold.
    """
    id_type = src.schema["doc_id"].dataType.simpleString()
    own = F.struct("doc_id", "row").eqNullSafe(F.struct("lo.doc_id", "lo.row"))
    pairs = anchors.where(~own).select("doc_id", "row", "start", F.least("n_words", "lo.n_words").alias("n_words"), "n_text", "n", F.col("lo.doc_id").alias("s_doc"), F.col("lo.row").alias("s_row"), F.col("lo.start").alias("s_start"), F.col("lo.n_text").alias("s_text"))
    texts = ["doc_id", "row", "s_doc", "s_row"]
    by_pair = Window.partitionBy(*texts)
    ordered = by_pair.orderBy("start")
    # of rows that are there twice one is enough
    pairs = pairs.withColumn("again", F.col("start") == F.lag("start").over(ordered)).where("again IS NULL OR NOT again").drop("again")
    most = F.greatest(F.lit(WIDE), F.sum("n_words").over(by_pair) / 2)
    gap, s_gap = (F.col(c) - F.lag(F.col(c) + F.col("n_words")).over(ordered) for c in ("start", "s_start"))
    pairs = pairs.withColumn("gap", gap).withColumn("s_gap", s_gap).withColumn("most", most)
    far = F.coalesce((F.col("gap") > F.col("most")) | (F.col("s_gap") > F.col("most")) | (F.col("s_gap") < 0), F.lit(True))
    pairs = pairs.withColumn("far", far).withColumn("apart", F.col("far") | (F.col("gap") != 0) | (F.col("s_gap") != 0))
    pairs = pairs.withColumn("chain", F.sum(F.col("far").cast("int")).over(ordered)).withColumn("segment", F.sum(F.col("apart").cast("int")).over(ordered))
    segments = pairs.groupBy(*texts, "chain", "segment").agg(F.min("start").alias("x"), F.min("s_start").alias("y"), F.sum("n_words").alias("k"), F.max("n").alias("n"), F.max("n_text").alias("n_text"), F.max("s_text").alias("s_text"))
    segments = ws.keep(segments.drop("segment"), "segments")

    along = Window.partitionBy(*texts, "chain").orderBy("x")
    end, s_end = F.col("x") + F.col("k"), F.col("y") + F.col("k")
    last, s_last = F.lag(end).over(along), F.lag(s_end).over(along)
    sided = segments.select(*texts, "chain", "x", "y", end.alias("e"), s_end.alias("s_e"), last.alias("p"), s_last.alias("s_p"), F.lead("x").over(along).isNull().alias("final"), "n_text", "s_text")
    hole = lambda when, side, a, z, b, s: F.when(when, F.struct(F.lit(side).alias("side"), F.col(a).alias("from"), F.col(z).alias("to"), F.col(b).alias("s_from"), F.col(s).alias("s_to")))
    three = F.array(
        hole(F.col("p").isNull() & (F.col("x") > 0) & (F.col("y") > 0), BEFORE, "x", "x", "y", "y"),
        hole((F.col("p") < F.col("x")) & (F.col("s_p") < F.col("y")), BETWEEN, "p", "x", "s_p", "y"),
        hole(F.col("final") & (F.col("e") < F.col("n_text")) & (F.col("s_e") < F.col("s_text")), BEHIND, "e", "e", "s_e", "s_e"),
    )
    holes = ws.keep(sided.select(*texts, "chain", F.explode(F.filter(three, lambda h: h.isNotNull())).alias("h")).select(*texts, "chain", "h.*"), "holes")
    span = lambda a, z: F.struct("side", F.col(a).alias("from"), F.col(z).alias("to"))
    asked = holes.select(F.col("doc_id").alias("q_id"), F.col("row").alias("q_row"), span("from", "to").alias("h")).union(holes.select("s_doc", "s_row", span("s_from", "s_to")))
    asked = ws.keep(asked.groupBy("q_id", "q_row").agg(F.collect_set("h").alias("asked")), "asked")
    texts_of = src.join(asked, F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("row") == F.col("q_row"))).select("doc_id", "row", "text", "asked")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SMALL_SLICE):
            raw, offs = utf8(b.column(2))
            w = split_words(raw, offs)
            words = w.hashes()[w.ids] if len(w.ids) else np.zeros(0, np.uint64)
            cut, begin, short = cut_paragraphs(words, w.counts)[0], w.row_start, words.astype(np.uint32).view(np.int32)
            out: list[list] = [[] for _ in range(5)]
            for r, holes_of in enumerate(b.column(3).to_pylist()):
                lo, hi = int(begin[r]), int(begin[r + 1])
                for h in holes_of:
                    a, z = lo + h["from"], lo + h["to"]
                    # equal words end less than REACH + 1 words behind the anchor that differs
                    if h["side"] == BEFORE:
                        k = np.searchsorted(cut, a) - 1
                        a = max(lo, (int(cut[k]) if k >= 0 else lo) - REACH - 1)
                    elif h["side"] == BEHIND:
                        k = np.searchsorted(cut, z, side="right")
                        z = min(hi, (int(cut[k]) if k < len(cut) else hi) + REACH + 1)
                    for c, v in zip(out, (r, h["side"], h["from"], h["to"], short[a:z])):
                        c.append(v)
            which = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:4]], pa.array(out[4], pa.list_(pa.int32()))], names=["doc_id", "row", "side", "from", "to", "words"])

    pieces = texts_of.mapInArrow(words_of, f"doc_id {id_type}, row long, side int, from long, to long, words array<int>")
    pieces = ws.keep(pieces.dropDuplicates(["doc_id", "row", "side", "from", "to"]), "pieces")
    h = holes.alias("h")
    at = lambda v, i, r, a, z: F.col(f"h.{i}").eqNullSafe(F.col(f"{v}.doc_id")) & (F.col(f"h.{r}") == F.col(f"{v}.row")) & (F.col("h.side") == F.col(f"{v}.side")) & (F.col(f"h.{a}") == F.col(f"{v}.from")) & (F.col(f"h.{z}") == F.col(f"{v}.to"))
    laid = h.join(pieces.alias("x"), at("x", "doc_id", "row", "from", "to")).join(pieces.alias("y"), at("y", "s_doc", "s_row", "s_from", "s_to"))
    laid = laid.select(*[f"h.{c}" for c in texts], "h.chain", "h.side", "h.from", "h.s_from", F.col("x.words").alias("xw"), F.col("y.words").alias("yw"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, spans = [], []
            xs, ys = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(8), b.column(9)))
            for r, (side, a, z) in enumerate(zip(*(b.column(i).to_pylist() for i in (5, 6, 7)))):
                x, y = (v[o[r] : o[r + 1]] for v, o in (xs, ys))
                dx, dy = (a - len(x), z - len(y)) if side == BEFORE else (a, z)
                for p in equal_stretches(x, y, side):
                    which.append(r)
                    spans.append((p[0] + dx, p[1] + dy, p[2]))
            values, t = np.array(spans, np.int64).reshape(-1, 3), pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(t) for i in range(5)], *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(3)]], names=[*texts, "chain", "x", "y", "k"])

    pair_type = f"doc_id {id_type}, row long, s_doc {id_type}, s_row long"
    stretches = laid.mapInArrow(compare, f"{pair_type}, chain long, x long, y long, k long").withColumn("n", F.lit(None).cast("long"))
    every = segments.select(*texts, "chain", "x", "y", "k", "n").unionByName(stretches)
    chains = every.groupBy(*texts, "chain").agg(F.max("n").alias("n"), F.collect_list(F.struct("x", "y", "k")).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, spans = [], []
            parts = b.column(6)
            offs, fields = parts.offsets.to_numpy(), [parts.values.field(i).to_numpy() for i in range(3)]
            for r in range(b.num_rows):
                for x, xz, y, yz in join_parts(list(zip(*(f[offs[r] : offs[r + 1]].tolist() for f in fields))), num, den):
                    which.append(r)
                    spans.append((x, xz - x, y, yz - y))
            values, t = np.array(spans, np.int64).reshape(-1, 4), pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(t) for i in (0, 1, 2, 3, 5)], *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(4)]], names=[*texts, "n", "start", "n_words", "s_start", "s_words"])

    met = ws.keep(chains.mapInArrow(joined, f"{pair_type}, n long, start long, n_words long, s_start long, s_words long"), "met")
    ws.free("segments", "holes", "asked", "pieces")
    settle(ws.spark)
    later = met.select("doc_id", "row", "start", "n_words", F.col("s_doc").alias("class_id"), F.col("n").alias("n_occurrences"), F.lit(False).alias("first"))
    earlier = met.select(F.col("s_doc").alias("doc_id"), F.col("s_row").alias("row"), F.col("s_start").alias("start"), F.col("s_words").alias("n_words"), F.col("s_doc").alias("class_id"), F.col("n").alias("n_occurrences"), F.lit(True).alias("first"))
    return later.unionByName(earlier).groupBy("doc_id", "row", "start", "n_words", "first").agg(F.min("class_id").alias("class_id"), F.max("n_occurrences").alias("n_occurrences"))


def repeated_runs(df: DataFrame, ws: Workspace, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, num: int = 80, den: int = 100, rows: int = 2) -> DataFrame:
    """Repeated paragraphs, anchors and ``whole_passages`` in runs of at least ``least`` words.

    ``run``: the first word of the run; ``removed``: words of the row that are there earlier
    and that no row before it in the run has; ``whole``: whether it is a paragraph or an anchor.
    """
    bands = tune_bands(num / den, rows)
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))
    found = candidates(src, ws, least, bands, rows)
    anchors = ws.keep(repeated_anchors(found, ws), "anchors")
    paragraphs = ws.keep(repeated_paragraphs(found, ws, num=num, den=den, bands=bands, rows=rows), "paragraphs")
    ws.free("occurrences", "classes", "info", "anchor-info", "lists", "one-small", "sketch-shared")
    settle(ws.spark)
    # rows that are there twice have every paragraph twice; one is enough
    whole = anchors.unionByName(paragraphs).groupBy("doc_id", "row", "start", "n_words").agg(F.min("lo").alias("lo"), F.max("n").alias("n_occurrences"))
    first = F.struct("doc_id", "row", "start").eqNullSafe(F.struct("lo.doc_id", "lo.row", "lo.start"))
    whole = whole.select("doc_id", "row", "start", "n_words", F.col("lo.doc_id").alias("class_id"), "n_occurrences", first.alias("first"), F.lit(True).alias("whole"))
    every = whole.unionByName(whole_passages(anchors, src, ws, num, den).withColumn("whole", F.lit(False)))
    every = every.withColumn("end", F.col("start") + F.col("n_words"))
    by_text = Window.partitionBy("doc_id", "row").orderBy("start", "end", "first", "whole")
    before = by_text.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    runs = every.withColumn("begin", F.when(new, F.col("start")))
    gone = F.coalesce(F.max(F.when(~F.col("first"), F.col("end"))).over(before), F.lit(0))
    runs = runs.withColumn("removed", F.when(F.col("first"), 0).otherwise(F.greatest(F.lit(0), F.col("end") - F.greatest("start", gone))))
    runs = runs.withColumn("run", F.last("begin", ignorenulls=True).over(by_text))
    return runs.drop("begin").withColumn("run_words", F.max("end").over(Window.partitionBy("doc_id", "row", "run")) - F.col("run")).where(F.col("run_words") >= least)


def repeated_passages(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, num: int = 80, den: int = 100, work_dir: str | None = None) -> DataFrame:
    """A row for every passage of at least ``least`` words that repeats across texts.

    doc_id, start and n_words (of the passage, in words), n_paragraphs (paragraphs and anchors
    in it), n_removed (words that have an earlier occurrence), class_id (lowest doc_id with one
    of its paragraphs), most_occurrences.  Null and empty texts and texts without words have no
    row.  Rows with a null id are texts like others.  Rows equal in id (both null included) and
    text are one text: they are no repeats of each other, and their passages are told once.
    Of equal passages the first is that of the lowest id, then hash of the text, then place.
    """
    ws = Workspace(df.sparkSession, "paragraphs", work_dir)
    runs = repeated_runs(df, ws, doc_id=doc_id, text=text, least=least, num=num, den=den)
    return runs.groupBy("doc_id", "row", "run").agg(
        F.first("run_words").alias("n_words"), F.sum(F.col("whole").cast("long")).alias("n_paragraphs"), F.sum("removed").alias("n_removed"),
        F.min("class_id").alias("class_id"), F.max("n_occurrences").alias("most_occurrences"),
    ).select("doc_id", F.col("run").alias("start"), "n_words", "n_paragraphs", "n_removed", "class_id", "most_occurrences")


def remove_repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, num: int = 80, den: int = 100, work_dir: str | None = None) -> DataFrame:
    """``df`` with repeated passages cut out of its texts; the columns stay.

    The first occurrence of a passage stays, by doc_id, then place.  A text that loses all
    its words goes; null texts and texts without words stay as they are.  Rows equal in id and
    text are one text and are all cut alike.
    """
    ws = Workspace(df.sparkSession, "paragraphs", work_dir)
    runs = repeated_runs(df, ws, doc_id=doc_id, text=text, least=least, num=num, den=den).where("NOT first")
    kept = df.columns
    own_id, own_row, own_cuts = (free_name(kept, x) for x in ("cut_id", "cut_row", "cuts"))
    cuts = runs.groupBy(F.col("doc_id").alias(own_id), F.col("row").alias(own_row)).agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias(own_cuts))
    cuts = ws.keep(cuts, "cuts")
    joined = df.select(*[F.col(f"`{c}`") for c in kept]).join(cuts, F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(own_row)), "left")
    at = kept.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, SMALL_SLICE):
            raw, offs = utf8(b.column(at))
            w = split_words(raw, offs)
            start, out = w.row_start, b.column(at).to_pylist()
            for r, spans in enumerate(b.column(len(kept)).to_pylist()):
                if not spans:
                    continue
                place = np.append(w.starts[start[r] : start[r + 1]] - offs[r], offs[r + 1] - offs[r])
                whole, parts, done = raw[offs[r] : offs[r + 1]].tobytes(), [], 0
                for s in spans:
                    a, z = int(place[min(s["start"], len(place) - 1)]), int(place[min(s["start"] + s["n_words"], len(place) - 1)])
                    parts.append(whole[done:a])
                    done = max(done, z)
                left = b"".join([*parts, whole[done:]]).decode()
                out[r] = left if left.strip(" \t\n\x0b\x0c\r") else None
            gone = pa.array([x is None and s is not None for x, s in zip(out, b.column(len(kept)).to_pylist())], pa.bool_())
            cols = [*b.columns[: len(kept)]]
            cols[at] = pa.array(out, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=kept).filter(pa.compute.invert(gone))

    return joined.select(*[F.col(f"`{c}`") for c in kept], own_cuts).mapInArrow(cut, df.schema)
