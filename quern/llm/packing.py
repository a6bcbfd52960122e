"""Best-fit packing of token pieces into sequences of bounded length.

Hierarchical residual packing: every partition packs its pieces best-fit
decreasing and gives out the bins that are nearly full; what is left of the
others goes on as items of the next round, over fewer partitions.  A round's
partitions are as many as its items need (``ROUND_ITEMS`` each), so no task ever
holds more than a bounded number of items.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import Workspace
from quern.llm.text import SMALL_SLICE, slices
from quern.llm.tokens import WORD_BPE, chunk_encoder

#: Chunks a worker remembers: packing ends a pipeline whose other stages have filled the executors.
MEMORY = 250_000
#: Items of one task in the rounds after the first.
ROUND_ITEMS = 100_000
ROUNDS = 3
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
LIST = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"


def token_pieces(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = WORD_BPE, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``size`` ids of every text, its end id included.

    Null and empty texts are one piece of one id; only longer texts are cut.
    """
    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer, MEMORY)
        for b in slices(batches, "text", SMALL_SLICE):
            ids, n = encoder.encode(b.column(1))
            ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
            n = n + 1
            k = -(-n // size)
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * size
            length = np.minimum(size, n[row] - start)
            at = (np.cumsum(n) - n)[row] + start
            view = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())), np.int64, len(row))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(cut, PIECE)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset in it) of each item, fill of each bin.

    Open bins wait by what is left in them; one integer's bits say which amounts
    are there, so the fullest bin that still takes an item is its lowest set bit.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    bits = 0
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        above = bits >> need
        if above:
            left = need + ((above & -above).bit_length() - 1)
            b = waiting[left].pop()
            if not waiting[left]:
                bits &= ~(1 << left)
        else:
            b, left = len(used), size
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += need
        left -= need
        if left:
            waiting[left].append(b)
            bits |= 1 << left
    return where, offset, np.array(used, np.int64)


def pack(pieces: DataFrame, ws: Workspace, *, size: int = 2048, slack: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """Place every piece: its columns, ``sequence_id`` and ``offset``.

    A bin with at most ``slack`` places left is given out as soon as it is made; the
    last round gives out all.  ``pieces`` must be reread from storage (``Workspace.keep``).
    """
    piece_type = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
    out_schema = pa.schema([("sequence_id", pa.int64()), ("used", pa.int32()), ("done", pa.bool_()), ("pieces", pa.list_(piece_type))])

    def round_of(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            items = pa.Table.from_batches(held).combine_chunks()
            used = items.column("used").to_numpy().astype(np.int64)
            lists = items.column("pieces").combine_chunks()
            flat, offs = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            offs = offs - offs[0]
            where, _, fill = best_fit(used, size)
            order = np.argsort(where, kind="stable")  # a bin's items together
            lens = offs[order + 1] - offs[order]
            idx = np.repeat(offs[order] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            per_bin = np.bincount(where[order], weights=lens, minlength=len(fill)).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(per_bin)])
            ids = (number << 56) + (TaskContext.get().partitionId() << 28) + np.arange(len(fill))
            taken = flat.take(pa.array(idx))
            length = taken.field("length").to_numpy()
            before = np.concatenate([[0], np.cumsum(length)])  # places follow each other without gaps
            offset = before[:-1] - np.repeat(before[bounds[:-1]], per_bin)
            taken = pa.StructArray.from_arrays([*(taken.field(f.name) for f in list(piece_type)[:-1]), pa.array(offset)], fields=list(piece_type))
            packed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), taken)
            done = np.full(len(fill), True) if last else fill >= size - slack
            table = pa.Table.from_arrays([pa.array(ids), pa.array(fill, pa.int32()), pa.array(done), packed], schema=out_schema)
            yield from table.to_batches(max_chunksize=5000)

        return run

    schema = f"sequence_id long, used int, done boolean, pieces {LIST}"
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    nowhere = F.lit(0).cast("long").alias("offset")
    # whole pieces need no partner
    packed = pieces.where(F.col("length") == size).select(*columns, F.monotonically_increasing_id().alias("sequence_id"), nowhere)
    items = pieces.where(F.col("length") < size).select(F.col("length").cast("int").alias("used"), F.array(F.struct(*columns, nowhere)).alias("pieces"))
    for number in range(1, rounds + 1):
        count = items.count()
        if number > 1:  # a tree: as many tasks as its items need
            items = items.repartition(max(1, math.ceil(count / ROUND_ITEMS)))
        last = number == rounds
        placed = ws.keep(items.mapInArrow(round_of(number, last), schema), f"round{number}")
        packed = packed.unionByName(placed.where("done").select("sequence_id", F.explode("pieces").alias("p")).select("p.*", "sequence_id"))
        if last or not count:
            return packed
        items = placed.where("NOT done").select("used", "pieces")
    return packed


def pack_documents(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = WORD_BPE, size: int = 2048, work_dir: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ws = Workspace(df.sparkSession, "packing", work_dir)
    pieces = ws.keep(token_pieces(df, doc_id=doc_id, text=text, tokenizer=tokenizer, size=size), "pieces")
    return pack(pieces, ws, size=size)
