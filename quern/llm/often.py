"""Keys that a corpus has twice or more, found with packed counts and kept in mapped arrays.

Most keys of a corpus are there once and can bring nothing together.  Tasks send the
distinct keys they have seen, a delta-coded blob a shard; a shard keeps the keys that
two tasks, or one task twice, have sent, with their counts.  Keys are cut to ``BITS`` bits
or more: a chance equality keeps a key that is not needed and loses none.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.packed import BLOB, blobs, by_shard, send, sum_by_key, unpack_sorted, unpack_values
from quern.llm.shared import Workspace, is_mounted, plan_bytes, replace_file

#: Files of repeated keys, and bits that keys are cut to, for a small table.
SHARDS, BITS = 256, 40
#: Bytes of the counted table a file; more files, and longer keys, beyond SHARDS of them.
SHARD_BYTES = 64 << 20
#: Keys that a counting task holds before it sends them.
HELD = 4_000_000


def layout(size: int | None) -> tuple[int, int]:
    """(files, bits of a key) for a table of ``size`` bytes: powers of two, four times the keys for twice the files."""
    level = min(10, max(0, math.ceil(math.log2(max(1, (size or 1) / (SHARDS * SHARD_BYTES))))))
    return SHARDS << level, BITS + 2 * level


def count_often(df: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], ws: Workspace, name: str) -> str | None:
    """Folder of the repeated keys and their counts; ``keys_of`` turns a task's batches into uint64 arrays.

    None where the shared folder is not mounted: then no key is sorted out beforehand,
    which costs shuffled rows and changes no result.
    """
    if not is_mounted(ws.uri):
        return None
    shards, bits = layout(plan_bytes(df))
    folder = ws.folder(f"{name}/{shards}-{bits}")
    cut, top = np.uint64(64 - bits), np.uint64(bits - shards.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            yield from send(blobs((k >> top).astype(np.int64), k, c))

        for keys in keys_of(batches):
            held.append(keys >> cut)
            size += len(keys)
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for s, keys, values in by_shard(batches):
            k, c = sum_by_key([unpack_sorted(x) for x in keys], [unpack_values(x) for x in values])
            replace_file(os.path.join(folder, f"{s:06d}.n"), [np.minimum(c[c > 1], 2**32 - 1).astype("<u4")])
            replace_file(os.path.join(folder, f"{s:06d}"), [k[c > 1].astype("<u8")])
            n += int((c > 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    parts = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions"))) * (shards // SHARDS)
    df.mapInArrow(count, BLOB).repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(merge, "n long").agg(F.sum("n")).collect()
    return folder


class OftenKeys:
    """A worker's handle to such a folder."""

    def __init__(self, folder: str | None):
        self.folder, self.maps = folder, {}
        if folder:
            self.shards, self.bits = (int(x) for x in os.path.basename(folder).split("-"))

    def _map(self, path: str, kind: str) -> np.ndarray:
        return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)

    def df(self, keys: np.ndarray) -> np.ndarray:
        """How often each key was counted; 1 for those that are not there twice, 2 for all without a folder.

        A function of the key alone, so it orders keys everywhere alike.
        """
        if self.folder is None:
            return np.full(len(keys), 2, np.uint32)
        k = keys >> np.uint64(64 - self.bits)
        out = np.ones(len(k), np.uint32)
        order = np.argsort(k)
        shard = (k[order] >> np.uint64(self.bits - self.shards.bit_length() + 1)).astype(np.int64)
        edge = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(k)]):
            s = int(shard[a])
            if s not in self.maps:
                path = os.path.join(self.folder, f"{s:06d}")
                if len(self.maps) >= 1024:
                    self.maps.clear()
                self.maps[s] = self._map(path, "<u8"), self._map(f"{path}.n", "<u4")
            at, (known, n) = order[a:z], self.maps[s]
            if len(known):
                p = np.minimum(np.searchsorted(known, k[at]), len(known) - 1)
                out[at] = np.where(known[p] == k[at], n[p], 1)
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.df(keys) > 1


def rarest_first(values: np.ndarray, n: np.ndarray, df: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``values``, row) of the ``most`` rarest of each row's n values that are not its own; and each row's m.

    Rarest by ``df``, ties by value; values of df 1 are a row's own and come first.  m: values that are not.
    """
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, df, row))
    rank = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    at = order[(rank < np.repeat(most, n)) & (df[order] > 1)]
    return at, row[at], np.bincount(row[df > 1], minlength=len(n))
