"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Every text's set of word shingles is hashed; equal sets form a class.
2. A class keeps its ``k`` lowest hashes.  Inverted lists of the lowest ``LISTED`` of them,
   entered rarest first and only as far as a sketch can miss a partner above the
   threshold, bring classes together (see ``linking``).
3. The union sketch of a pair, the k lowest hashes of both, estimates its Jaccard
   similarity; pairs more than six standard deviations below the threshold go.
4. What remains is verified on whole sets; links form components.

The chance that a pair at the threshold is missed by 2 or 3 is below 1e-8; for sets
of at most ``LISTED`` shingles nothing is left to chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.linking import link_lists
from quern.llm.often import OftenKeys, count_often, rarest_first
from quern.llm.shared import Workspace, n_rows, small
from quern.llm.text import SMALL_SLICE, mix64, shingle_hashes, slices, split_words, utf8

K, LISTED = 64, 32
#: Ids that a broadcast may hold when texts are looked up again; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    raw, offs = utf8(column)
    w = split_words(raw, offs)
    h, n = shingle_hashes(w.hashes()[w.ids] if len(w.ids) else np.zeros(0, np.uint64), w.counts, size)
    at = 0
    for m in n.tolist():
        yield np.unique(h[at : at + m])
        at += m


def signed(s: np.ndarray) -> np.ndarray:
    """Hashes as longs of the same order."""
    return (s ^ np.uint64(1 << 63)).view(np.int64)


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.astype("<u8").tobytes())


def sketches(df: DataFrame, *, size: int) -> DataFrame:
    """(doc_id, n_shingles, c, sketch) of ``df(doc_id, text)``; c is null without words."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SMALL_SLICE):
            n, c, low = [], [], []
            for s in _sets(b.column(1), size):
                n.append(len(s))
                c.append(fingerprint(s) if len(s) else None)
                low.append(signed(s[:K]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "c", "sketch"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_shingles long, c binary, sketch array<bigint>")


def sketch_lists(classes: DataFrame, ws: Workspace, num: int, den: int) -> DataFrame:
    """Inverted lists (key, c, n) of the lowest ``LISTED`` values, rarest first; n: size of the whole set.

    Of two sketches of m values at the threshold fewer than ``need`` are common only
    with negligible probability, so the m - need + 1 rarest hold one of them.
    """
    least = max(1, math.floor(LISTED * num / den - 7 * math.sqrt(LISTED * num / den * (1 - num / den))))

    def low(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(values of all rows, values of each row)."""
        lists = batch.column("sketch")
        offs = lists.offsets.to_numpy().astype(np.int64)
        n = np.minimum(np.diff(offs), LISTED)
        at = np.repeat(offs[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return lists.values.to_numpy()[at].view(np.uint64), n

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield mix64(low(b)[0])

    lowest = classes.select("c", "sketch", "n_shingles")
    folder = count_often(lowest, keys_of, ws, "often")

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = OftenKeys(folder)
        for b in batches:
            keys, n = low(b)
            need = np.maximum(1, -(-n * least // LISTED))
            at, row, _ = rarest_first(keys, n, often.df(mix64(keys)), n - need + 1)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), b.column("c").take(row), b.column("n_shingles").take(row).cast(pa.int32())], names=["key", "c", "n"])

    return lowest.mapInArrow(rarest, "key long, c binary, n int")


def union_estimate(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose union sketch and set sizes allow the threshold.

    Of the K lowest values of both sketches together those in both estimate the similarity;
    where both sets are smaller than K the union is known whole.
    """
    t = num / den
    side = lambda x: classes.select(F.col("c").alias(x), F.col("sketch").alias(f"k{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    least = t - 6.5 * math.sqrt(t * (1 - t) / K)
    union = F.sort_array(F.array_union("ka", "kb"))
    union = F.when(F.greatest("na", "nb") >= K, F.slice(union, 1, K)).otherwise(union)
    common = F.size(F.array_intersect(union, F.array_intersect("ka", "kb")))
    return both.where(common >= least * F.size(union)).select("a", "b")


def find_components(df: DataFrame, ws: Workspace, *, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, c, component_id) of ``df(doc_id, text)``, a row each."""
    rows = ws.keep(sketches(df, size=size), "sketches")
    classes = ws.keep(rows.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "classes")
    lists = sketch_lists(classes, ws, num, den)

    def sets_of(need: DataFrame, name: str) -> DataFrame:
        """Whole sets of the classes (c), from the texts of their first documents."""
        few = small(need)
        ids = ws.keep(classes.join(few, "c", "left_semi").select("rep").distinct(), name)
        ids = F.broadcast(ids) if n_rows(ids) <= BROADCAST_IDS else ids
        # a class that only rows without an id have is found among those
        texts = df.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", SMALL_SLICE):
                s = [x for x in _sets(b.column(1), size) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in s], pa.binary()), pa.array([signed(x) for x in s], pa.list_(pa.int64()))], names=["c", "set"])

        return texts.mapInArrow(run, "c binary, set array<bigint>").join(few, "c", "left_semi").dropDuplicates(["c"])

    def estimate(pairs: DataFrame) -> DataFrame:
        need = ws.keep(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct(), "pair-classes")
        return union_estimate(pairs, classes.join(small(need), "c", "left_semi"), num, den)

    comps = link_lists(lists, sets_of, ws, num=num, den=den, estimate=estimate)
    named = classes.join(comps, "c", "left").select("c", "rep", F.coalesce("root", "c").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = ws.keep(named.join(lowest, "root").select("c", "component_id"), "named")
    return rows.join(of_class, "c", "left").select("doc_id", "n_shingles", "c", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100, work_dir: str | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Links join texts with den * intersection >= num * union of their ``size``-word shingle
    sets; component_id is the smallest doc_id reachable.  A text of fewer words has its
    whole sequence as one shingle; null texts and texts without words link with nothing.
    Rows with a null id link like others; the component of a group without any id is null.
    """
    ws = Workspace(df.sparkSession, "near", work_dir)
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    got = find_components(src, ws, size=size, num=num, den=den)
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
