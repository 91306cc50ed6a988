"""Packing documents into training sequences by best-fit decreasing.

Each task packs the documents of its input split, block by block: a block holds at most ``block_tokens`` ids, so
memory is bounded, nothing is shuffled, and a second attempt of a task makes the same sequences.  In a block,
an overlong document is first cut into full windows; the remainders are placed in order of decreasing length, each
into the open window with the least room that still holds it.  The open windows stand in a segment tree
indexed by remaining capacity.  Windows left with more than ``slack`` free places are opened again: their
pieces fill windows one after the other, cut where a window ends, and what is left at the very end is cut into
powers of two, which need no padding.

Defined cases: a null text is empty and yields the end id alone; null and repeated ids are packed like others, row by
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import encoded, selected

#: Sequences of one task: its number in the high bits.
_TASK_BITS = 33

Piece = tuple[int, int, int]  # document's place in the block, start, length


class OpenWindows:
    """Open windows by remaining capacity, 0 to ``size``; the tightest that fits is found in log(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        node = self.leaves + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its room) with the least room of at least ``need``, taken out; None if there is none."""
        has, node = self.any, self.leaves + need
        if not has[node]:
            while node > 1 and (node & 1 or not has[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if has[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            has[node] = 0
            node >>= 1
            while node and not (has[2 * node] or has[2 * node + 1]):
                has[node] = 0
                node >>= 1
        return window, room


def pack(lengths: list[int], size: int, slack: int) -> list[list[Piece]]:
    """Sequences of pieces that hold every id of documents of these lengths once."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for i, n in enumerate(lengths):
        full += [[(i, at, size)] for at in range(0, n - size + 1, size)]
        if n % size:
            rest.append((i, n - n % size, n % size))
    rest.sort(key=lambda p: (-p[2], p[0]))
    open_, made, rooms = OpenWindows(size), [], []
    for piece in rest:
        found = open_.take(piece[2])
        if found is None:
            made.append([piece])
            rooms.append(size - piece[2])
            found = len(made) - 1, size
        else:
            made[found[0]].append(piece)
            rooms[found[0]] -= piece[2]
        if rooms[found[0]]:
            open_.add(found[0], rooms[found[0]])
    good = lambda w: rooms[w] <= slack or (size - rooms[w]).bit_count() == 1
    full += [m for w, m in enumerate(made) if good(w)]
    return full + refill([p for w, m in enumerate(made) if not good(w) for p in m], size)


def refill(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """These pieces one after the other, cut into full windows and at the end into powers of two."""
    left = sum(p[2] for p in pieces)
    out, now, room = [], [], 0
    for i, start, n in pieces:
        while n:
            if not room:
                now = []
                out.append(now)
                room = size if left >= size else 1 << (left.bit_length() - 1)
            got = min(n, room)
            now.append((i, start, got))
            start, n, room, left = start + got, n - got, room - got, left - got
    return out


def blocks(rows: Iterable[tuple[int | None, bytes]], width: int, most: int) -> Iterator[tuple[list[int | None], list[bytes]]]:
    ids, packed, n = [], [], 0
    for doc, data in rows:
        if ids and n + len(data) // width > most:
            yield ids, packed
            ids, packed, n = [], [], 0
        ids.append(doc)
        packed.append(data)
        n += len(data) // width
    if ids:
        yield ids, packed


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, block_tokens: int = 2 << 20, slack: int = 16) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces with their ids as 32-bit little-endian bytes."""

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << _TASK_BITS
        rows = (r for ids, packed in encoded(batches, tokenizer, end_id, "<u4") for r in zip(ids.to_pylist(), packed, strict=True))
        for ids, packed in blocks(rows, 4, block_tokens):
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            out: list[list] = [[] for _ in names]
            for pieces in pack([len(x) // 4 for x in packed], size, slack):
                offset = 0
                for i, start, n in pieces:
                    for column, value in zip(out, (ids[i], start, n, packed[i][4 * start : 4 * (start + n)], len(packed[i]) // 4, sequence, offset), strict=True):
                        column.append(value)
                    offset += n
                sequence += 1
                if len(out[0]) >= 4096:
                    yield _batch(out, names)
                    out = [[] for _ in names]
            yield _batch(out, names)

    return selected(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _batch(columns: list[list], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=list(names))


def padding(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and places padded where sequences are padded to ``size`` except at a power of two."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(F.bit_count("n") == 1, 0).otherwise(size - F.col("n"))).alias("padding"))
