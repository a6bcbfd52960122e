"""Token files with random access: directly addressable codes.

An id is split into 8-bit chunks, lowest first, one level a chunk.  A level holds
the chunks of the ids that reach it, a bitmap that says which of them go on, and a
directory of the ones before every 512th bit.  The token at place i is read by
following ranks upwards: no block is decoded for it, and a range of tokens is a
range of each level.

File: 8 bytes magic, 8 bytes header length, JSON header (name, dtype, offset and
count of each section), then the sections, each at a multiple of 8 bytes.
"""

from __future__ import annotations

import json
import mmap
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import Workspace, replace_file
from quern.llm.text import slices
from quern.llm.tokens import BYTE_BPE, chunk_encoder

MAGIC = b"DACIDS01"
BLOCK = 512
#: A file is closed at the document that brings it to so many ids.
FILE_IDS = 8_000_000
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def _levels(ids: np.ndarray) -> dict[str, np.ndarray]:
    out, rest, k = {}, ids.astype(np.uint32), 0
    while True:
        out[f"chunks{k}"] = (rest & 0xFF).astype(np.uint8)
        more = rest > 0xFF
        if not more.any():
            return out
        bits = np.packbits(more, bitorder="little")
        per = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), BLOCK // 8))
        out[f"more{k}"] = bits
        out[f"ranks{k}"] = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        rest, k = rest[more] >> 8, k + 1


def encode_file(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The bytes of one file as a list of blobs."""
    sections = {"doc_ids": doc_ids.astype(np.int64), "null_ids": null.astype(np.uint8), "doc_offsets": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)} | _levels(ids)
    head, at, body = [], 0, []
    for name, a in sections.items():
        raw = np.ascontiguousarray(a).tobytes()
        head.append([name, a.dtype.str, at, len(a)])
        pad = -len(raw) % 8
        body += [raw, b"\0" * pad]
        at += len(raw) + pad
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return [MAGIC, len(text).to_bytes(8, "little"), text, *body]


class TokenFile:
    """A memory-mapped file; ``file[i]`` and ``file.range(a, b)`` read single places."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != MAGIC:
            raise ValueError(f"{path} is no token file")
        size = int.from_bytes(self._map[8:16], "little")
        self._s = {n: np.frombuffer(self._map, np.dtype(t), k, 16 + size + at) if k else np.zeros(0, np.dtype(t)) for n, t, at, k in json.loads(self._map[16 : 16 + size])}
        self.doc_ids, self.doc_offsets = self._s["doc_ids"], self._s["doc_offsets"]
        self.null_ids = self._s["null_ids"].astype(bool)

    def __len__(self) -> int:
        return int(self.doc_offsets[-1])

    def _rank(self, k: int, i: int) -> int:
        """Ones of level k's bitmap before place i."""
        bits = self._s[f"more{k}"]
        b = i // BLOCK
        n = int(self._s[f"ranks{k}"][b])
        n += int(_ONES[bits[b * BLOCK // 8 : i // 8]].sum())
        if i % 8:
            n += int(_ONES[int(bits[i // 8]) & ((1 << i % 8) - 1)])
        return n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, k = int(self._s["chunks0"][i]), 0
        while f"more{k}" in self._s and self._s[f"more{k}"][i // 8] >> (i % 8) & 1:
            i, k = self._rank(k, i), k + 1
            value |= int(self._s[f"chunks{k}"][i]) << 8 * k
        return value

    def range(self, a: int, b: int, k: int = 0) -> np.ndarray:
        """Ids at places a to b - 1."""
        out = self._s[f"chunks{k}"][a:b].astype(np.uint32)
        if f"more{k}" in self._s and b > a:
            bits = np.unpackbits(self._s[f"more{k}"][a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            lo = self._rank(k, a)
            out[bits] |= self.range(lo, lo + int(bits.sum()), k + 1) << np.uint32(8)
        return out

    def document(self, n: int) -> np.ndarray:
        """Ids of the file's n-th document, its end id included."""
        return self.range(int(self.doc_offsets[n]), int(self.doc_offsets[n + 1]))


def write_tokens(df: DataFrame, ws: Workspace, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encode texts and write token files in ascending ``doc_id`` order (null ids first).

    Returns one row a file: path, part, seq, first_doc, n_docs, n_tokens, start (ids of
    all files before it).  Null texts are empty: their one id is ``end_id``.  Rows with
    the same id are ordered by a hash of the text.  Each file is written under a name
    of its own and moved, so a repeated task writes the same file again.
    """
    folder = ws.folder("tokens")
    n = partitions or int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    tie = F.xxhash64("text")
    src = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        docs, nulls, counts, ids, held, rows = [], [], [], [], 0, []

        def close():
            d, z = np.concatenate(docs), np.concatenate(nulls)
            path = os.path.join(folder, f"part-{part:07d}-{len(rows):05d}.dac")
            replace_file(path, encode_file(d, z, np.concatenate(counts), np.concatenate(ids)))
            rows.append((path, part, len(rows), None if z[0] else int(d[0]), len(d), held))
            for x in (docs, nulls, counts, ids):
                x.clear()

        for b in slices(batches, "text"):
            got, k = encoder.encode(b.column(1))
            ends = np.cumsum(k)
            got = np.insert(got, ends, end_id) if len(ends) else got
            key = b.column(0)
            docs.append(key.fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(key.is_null().to_numpy(zero_copy_only=False))
            counts.append(k + 1)
            ids.append(got)
            held += len(got)
            if held >= FILE_IDS:
                close()
                held = 0
        if docs:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "part", "seq", "first_doc", "n_docs", "n_tokens"])

    files = ws.keep(src.mapInArrow(write, "path string, part long, seq long, first_doc long, n_docs long, n_tokens long"), "files")
    # one small row a file (millions of ids each): the only thing that is put in one order
    listed = sorted(files.collect(), key=lambda r: (r.part, r.seq))
    start, out = 0, []
    for r in listed:
        out.append((*r, start))
        start += r.n_tokens
    return ws.spark.createDataFrame(out, files.schema.add("start", "long"))


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = TokenFile(path)
                at = f.doc_offsets
                step = 1 << 20
                crcs, lo = np.zeros(len(f.doc_ids), np.int64), 0
                while lo < len(f.doc_ids):  # whole documents, about a million ids at once
                    hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, side="right")) - 1)
                    ids = f.range(int(at[lo]), int(at[hi])).astype("<u4")
                    view = memoryview(ids).cast("B")
                    for j in range(lo, hi):
                        crcs[j] = zlib.crc32(view[4 * int(at[j] - at[lo]) : 4 * int(at[j + 1] - at[lo])])
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, mask=f.null_ids), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, work_dir: str | None = None) -> DataFrame:
    """Write the token files of ``df`` and return what they hold per document."""
    ws = Workspace(df.sparkSession, "tokens", work_dir)
    return read_tokens(write_tokens(df, ws, doc_id=doc_id, text=text, tokenizer=tokenizer))
