"""Best-fit packing of tokenized documents by hierarchical residual packing.

Each partition packs its own pieces, the largest first, each into the bin with the least room that still holds it. Bins that
are nearly full are final. The others become items themselves, meet in fewer partitions and are packed again, until one
partition is left or a round hardly joins any; a task never packs more than ``WINDOW`` items at a time.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .tables import materialize

WINDOW = 20_000
#: Partitions that feed one of the next round at least.
FAN_IN = 8
#: A round that leaves more than this share of the bins is the last.
STALLED = 0.98

MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))
BINS = "bin_id long, fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of places in ``sizes``: largest first, each into the fullest bin that has room. Ties: the earlier place first."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r exists
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fitting = rooms >> sizes[i]
        if fitting:
            room = sizes[i] + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        room -= sizes[i]
        if not with_room[room]:
            rooms |= 1 << room
        with_room[room].append(at)
    return bins


def pieces(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32) of a document's identifiers; all pieces but the first are full."""
    start, piece = 0, 0
    end = (len(ids) - 1) % capacity + 1
    while start < len(ids):
        yield piece, start, end - start, zlib.crc32(ids[start:end].astype("<u4").tobytes())
        piece, start, end = piece + 1, end, end + capacity


class Bins:
    """Items waiting to be packed, and the numbering of a task's bins."""

    def __init__(self, round_: int, capacity: int):
        self.capacity, self.number = capacity, round_ << 56 | TaskContext.get().partitionId() << 28
        self.sizes: list[int] = []
        self.items: list[list[dict]] = []

    def add(self, size: int, members: list[dict]) -> None:
        self.sizes.append(size)
        self.items.append(members)

    def packed(self) -> Iterator[pa.RecordBatch]:
        rows = []
        for bin_ in best_fit(self.sizes, self.capacity):
            members, fill = [], 0
            for i in bin_:
                members += [m | {"offset": m["offset"] + fill} for m in self.items[i]]
                fill += self.sizes[i]
            rows.append((fill, members))
        for k in range(0, len(rows), 5_000):
            part = rows[k : k + 5_000]
            ids = np.arange(self.number, self.number + len(part))
            self.number += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f for f, _ in part], pa.int32()), pa.array([m for _, m in part], MEMBERS)], names=["bin_id", "fill", "members"])
        self.sizes, self.items = [], []


def tokenized(documents: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The first round: bins of the pieces of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = vocabulary(path).encode, Bins(0, capacity)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id))
                for piece, start, length, crc in pieces(ids, capacity):
                    bins.add(length, [{"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "offset": 0}])
                if len(bins.sizes) >= WINDOW:
                    yield from bins.packed()
        yield from bins.packed()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BINS)


def packed_again(bins: DataFrame, round_: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = Bins(round_, capacity)
        for batch in batches:
            for fill, members in zip(batch.column("fill").to_pylist(), batch.column("members").to_pylist()):
                packing.add(fill, members)
                if len(packing.sizes) >= WINDOW:
                    yield from packing.packed()
        yield from packing.packed()

    return bins.mapInArrow(run, BINS)


def pack(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, full: float = 0.996) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the token identifiers of its text and then ``end_id``; only one of more than ``capacity`` is cut, all pieces
    but its first being full. The pieces of a sequence follow each other from offset 0 without gaps and fill at most
    ``capacity``. Null and empty texts are ``end_id`` alone; repeated rows and null doc_ids are packed as documents of their own;
    an empty table gives no rows; other columns are not read. doc_id is an integer, or a text that Spark casts to a long (one that
    isn't is an error).
    """
    final = []
    bins = materialize(tokenized(documents, path, capacity, end_id), "packing")
    nearly_full = F.col("fill") >= int(capacity * full)
    partitions, left, round_ = 1 << 30, None, 0
    while True:
        final.append(bins.where(nearly_full))
        underfull = bins.where(~nearly_full)
        count = underfull.count()
        partitions = min(-(-partitions // FAN_IN), -(-count // WINDOW))
        if count == 0 or left is not None and (left[0] == 1 or count > STALLED * left[1]):
            final.append(underfull)
            break
        left, round_ = (partitions, count), round_ + 1
        # items are dealt at random, so that each partition sees the sizes of all
        bins = materialize(packed_again(underfull.repartition(partitions), round_, capacity), "packing")
    every = functools.reduce(DataFrame.unionByName, final)
    return every.select(F.col("bin_id").alias("sequence_id"), F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
