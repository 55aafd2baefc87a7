"""Packing token sequences by best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import bounded_batches, frugal
from granary.llm.tokens import byte_bpe, vocabulary_path

CAPACITY = 2048
END_ID = 1
#: Pieces and tokens that one task holds before it packs what it has.
BLOCK_PIECES, BLOCK_TOKENS = 500_000, 64_000_000
#: Sequence ids of a task start at its number times this.
STRIDE = 1 << 40


class OpenWindows:
    """Open windows in a segment tree indexed by remaining capacity; a node counts the windows below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with room for need, and its room: the first counted leaf from need on."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a right sibling has windows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.at[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return window, room


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """Window and offset of every length (0 < length <= capacity), and the number of windows; ties in the given order."""
    windows, offsets, n, open_ = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_.take(lengths[i])
        if found is None:
            found, n = (n, capacity), n + 1
        windows[i], offsets[i] = found[0], capacity - found[1]
        if left := found[1] - lengths[i]:
            open_.put(left, found[0])
    return windows, offsets, n


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array<int>) if asked.

    A document is its text's ids and end_id. Full windows are cut off first, the rests are packed by
    best-fit decreasing. A null or empty text is end_id alone; a null id stays null; repeated rows
    are packed each; an empty table gives no rows; other columns aren't read. Each task packs the
    rows that it has read, so nothing is shuffled: at most its last windows stay less than full,
    and a task that reads very much packs in blocks of bounded size. Sequence ids are unique, not dense.
    """
    path = path or vocabulary_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, first = byte_bpe(path), TaskContext.get().partitionId() * STRIDE
        rows, tokens = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, rows, tokens
            rest = [i for i, r in enumerate(rows) if r[2] < capacity]
            windows, offsets, n = best_fit_decreasing([rows[i][2] for i in rest], capacity)
            place = dict(zip(rest, zip(windows, offsets)))
            ids = []
            for i, r in enumerate(rows):
                if i not in place:
                    place[i], n = (n, 0), n + 1
            out = [[r[k] for r in rows] for k in range(5)] + [[first + place[i][0] for i in range(len(rows))], [place[i][1] for i in range(len(rows))]]
            cols = [pa.array(x, pa.int64()) for x in out]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ids = [r[5].astype("<i4") for r in rows]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))))
                names.append("ids")
            table = pa.RecordBatch.from_arrays(cols, names)
            for at in range(0, len(rows), 10_000):
                yield table.slice(at, 10_000)
            first, rows, tokens = first + n, [], 0

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(bpe.encode(text.as_py() or ""), np.array([end_id], "<u4")).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((key, start, len(part), zlib.crc32(part.tobytes()), len(ids), part if with_ids else None))
                tokens += len(ids) if with_ids else 0
            if len(rows) >= BLOCK_PIECES or tokens >= BLOCK_TOKENS:
                yield from packed()
        if rows:
            yield from packed()

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string")).mapInArrow(frugal(run), schema)
