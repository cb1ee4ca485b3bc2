"""Documents into fixed windows of tokens: best-fit decreasing.

A text longer than a window is first cut into full windows. What remains is packed by
decreasing length: a segment tree over the free room finds the fullest open window that still
takes the piece. A task packs the rows of its own input in blocks of ``block`` remainders, so
nothing moves between tasks and its memory is bounded; a block leaves one partly filled window
or a few, against hundreds or thousands of full ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import as_u32, encoder

BLOCK = 16_384


class RoomTree:
    """Open windows by free room; ``best(n)`` is the least room of at least ``n`` that some window has."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def best(self, need: int) -> int | None:
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, room: int) -> int:
        window = self.open[room].pop(0)
        at = room + self.leaves
        if not self.open[room]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return window


def best_fit_decreasing(lengths: list[int], width: int) -> list[tuple[int, int]]:
    """For each piece the window and the place in it. Equal pieces go in the order given."""
    tree, used, out = RoomTree(width), [], [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.best(n)
        window = len(used) if room is None else tree.take(room)
        if room is None:
            used.append(0)
        out[i] = (window, used[window])
        used[window] += n
        if used[window] < width:
            tree.put(width - used[window], window)
    return out


_PIECES = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("key_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, width: int = 2048, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Pieces ``key, start, ids, key_tokens, sequence_id, offset``; ``ids`` are little-endian unsigned 32-bit words.

    A null text counts as empty and gives the end id alone; keys are whole numbers, may be null
    and may repeat: every row of the input is packed by itself. Other columns are not read. An
    empty table gives an empty result. Ties go by key, then text.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped.value)
        next_id = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            held.sort(key=lambda x: (x[0] is None, x[0] or 0, x[2]))
            places = best_fit_decreasing([len(x[2]) // 4 for x in held], width)
            for at in range(0, len(held), 1024):
                yield rows([(*x, next_id + w, o) for x, (w, o) in zip(held[at : at + 1024], places[at : at + 1024], strict=True)])
            next_id += 1 + max(w for w, _ in places)
            held = []

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                full: list[tuple] = []
                for k, x in zip(part.column(0).to_pylist(), enc.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids = as_u32(x, enc.dtype, end_id)
                    whole = len(ids) // width * width
                    for s in range(0, whole, width):
                        full.append((k, s, ids[s : s + width].tobytes(), len(ids), next_id, 0))
                        next_id += 1
                    if whole < len(ids):
                        held.append((k, whole, ids[whole:].tobytes(), len(ids)))
                if full:
                    yield rows(full)
                if len(held) >= block:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, start long, ids binary, key_tokens long, sequence_id long, offset long")
