"""Bounded-space online packing of documents into fixed-length token windows.

Each partition streams its documents once and keeps at most ``open_windows`` windows. Whole windows
are cut off long documents; what remains is placed in the open window that it fits best, and when
none fits the fullest window is emitted and a fresh one opened. Leftover windows of all partitions
are merged at the end: their pieces are dealt over a number of tasks that grows with them, joined one
after the other and cut at the window length, so that only the last window of a task can be short.

Pieces carry their ids. A sequence is padded to ``length`` unless its own length is a power of two.

Defined results: null or empty text is a document of the end id alone; repeated documents are packed
each; an empty table gives no rows; other columns are not touched."""
from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import word_tokenizer

LENGTH = 2048
OPEN = 64
LEFT_PER_TASK = 4096  # leftover pieces that one task merges
#: Sequence ids of merged windows start here; those of partition p at p << 32.
MERGED = 1 << 60
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


class OpenWindows:
    """Best-fit over at most ``most`` windows. A piece is (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.room: list[tuple[int, int]] = []  # (room, window), ascending
        self.windows: dict[int, list[tuple]] = {}
        self.next = 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece (shorter than a window); returns a window that had to be emitted, or that is full."""
        n, out = piece[2], None
        at = bisect.bisect_left(self.room, (n, -1))
        if at < len(self.room):
            room, w = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                _, w = self.room.pop(0)
                out = self.windows.pop(w)
            room, w = self.length, self.next
            self.next += 1
            self.windows[w] = []
        self.windows[w].append(piece)
        if room == n:
            return self.windows.pop(w)  # a full window was an open one, so nothing else was emitted
        bisect.insort(self.room, (room - n, w))
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed at the vocabulary's width), doc_tokens,
    sequence_id, offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokenizer(tokenizer)
        width, end = t.dtype.itemsize, np.array([end_id], t.dtype).tobytes()
        windows, seq, rows = OpenWindows(length, open_windows), TaskContext.get().partitionId() << 32, []

        def emit(pieces: list[tuple], is_open: bool = False) -> None:
            nonlocal seq
            offset = 0
            for p in pieces:
                rows.append((*p, seq, offset, is_open))
                offset += p[2]
            seq += 1

        for b in common.slices(batches, "text"):
            for key, ids in zip(b.column("doc_id").to_pylist(), t.encode([x or "" for x in b.column("text").to_pylist()])):
                ids += end
                n = len(ids) // width
                whole = n - n % length
                for a in range(0, whole, length):
                    emit([(key, a, length, ids[a * width : (a + length) * width], n)])
                if n > whole and (done := windows.place((key, whole, n - whole, ids[whole * width :], n))):
                    emit(done)
            if rows:
                yield _batch(rows)
                rows = []
        for _, w in sorted(windows.room):
            emit(windows.windows[w], True)
        if rows:
            yield _batch(rows)

    made = common.materialize(docs.mapInArrow(first, SCHEMA), "packed")
    left = made.where("open").select("doc_id", "start", "length", "ids", "doc_tokens")
    tasks = max(1, -(-left.count() // LEFT_PER_TASK))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, used, rows = MERGED | TaskContext.get().partitionId() << 32, 0, []
        for b in batches:
            for key, start, n, ids, total in zip(*(c.to_pylist() for c in b.columns)):
                width = len(ids) // n
                while n:
                    take = min(n, length - used)
                    rows.append((key, start, take, ids[: take * width], total, seq, used, False))
                    ids, start, n, used = ids[take * width :], start + take, n - take, used + take
                    if used == length:
                        seq, used = seq + 1, 0
            if rows:
                yield _batch(rows)
                rows = []

    # Written before use: a piece must not be dealt differently by a second run of a task.
    dealt = left.repartition(tasks, F.xxhash64("doc_id", "start")).sortWithinPartitions("doc_id", "start", "ids")
    merged = common.materialize(dealt.mapInArrow(merge, SCHEMA), "packed-left")
    return made.where("not open").unionByName(merged).drop("open")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def digest(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with ids_crc32 (ids as little-endian u32) instead of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_tokenizer(tokenizer).dtype
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
            at = b.schema.get_field_index("ids")
            yield b.set_column(at, pa.field("ids_crc32", pa.int64()), pa.array(crc, pa.int64()))

    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
