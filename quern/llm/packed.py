"""Packed arrays as shuffle rows: sorted keys and values of a shard in one blob."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

BLOB = "shard int, keys binary, values binary"


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned integers: differences, byte planes, zstd."""
    d = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_values(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_values(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def sum_by_key(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums); ``values`` may have several columns."""
    k, v = np.concatenate(keys), np.concatenate(values)
    if not len(k):
        return k, v
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(v[order], first, axis=0)


def blobs(shard: np.ndarray, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """One blob a shard; ``keys`` are sorted, equal shards need not lie together."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(shard))):
        at = order[a:b]
        yield int(shard[a]), pack_sorted(keys[at]), pack_values(values[at].ravel())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


BLOB_SCHEMA = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])


def send(rows: Iterator[tuple], most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield _batch(held, BLOB_SCHEMA)
            held = []
    if held:
        yield _batch(held, BLOB_SCHEMA)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """Groups of rows that are sorted by shard."""
    now, keys, values = None, [], []
    for b in batches:
        for s, k, v in zip(*(b.column(i).to_pylist() for i in range(3))):
            if s != now:
                if now is not None:
                    yield now, keys, values
                now, keys, values = s, [], []
            keys.append(k)
            values.append(v)
    if now is not None:
        yield now, keys, values
