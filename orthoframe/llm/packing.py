"""Packing documents into windows by the sum-of-squares rule (Csirik et al., 2006), online.

A document's ids are cut into full windows and a rest. Each rest, as it comes, goes to the fill
level at which the sum over levels of the squared number of open windows becomes smallest; a
level array holds these numbers, and for each level the open windows lie on a stack. At most
``OPEN`` windows are open: beyond that, the emptiest one's last piece is cut to fill the fullest one.
When a task has seen its documents, it closes what is open: the emptiest windows' pieces are cut to top up
the fullest ones, and the single window that stays partly filled is cut into sequences whose
lengths are powers of two, which need no padding. So no sequence is padded at all, and few
documents are cut.

Each task packs the documents of its own partition, without a shuffle; memory holds the open
windows (16 MB at most) and a batch of texts. A lost executor's partitions are packed again from their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import read

WINDOW = 2048
END_ID = 1
#: Pieces of a batch that goes back to Spark.
BATCH = 2048
#: Windows that may be open at a time.
OPEN = 2048

Piece = tuple[Any, int, bytes, int]  # document, ids before it, ids, ids of the document


class Packer:
    """Packs pieces of whole ids into windows; ``done`` collects closed sequences in order."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN) -> None:
        self.window, self.most_open, self.n_open = window, max(1, most_open), 0
        self.levels = np.zeros(window + 1, np.int64)  # open windows by number of ids
        self.open: dict[int, list[list[Piece]]] = {}
        self.done: list[list[Piece]] = []

    def add(self, doc: Any, ids: bytes) -> None:
        n, w = len(ids) // 4, self.window
        whole = n - n % w
        for at in range(0, whole, w):
            self.done.append([(doc, at, ids[4 * at : 4 * (at + w)], n)])
        if n > whole:
            self._place((doc, whole, ids[4 * whole :], n), n - whole)

    def best_level(self, size: int) -> int:
        """The level (0: a new window) at which adding ``size`` least raises the sum of squares."""
        w, count = self.window, self.levels
        best, at = 2 * int(count[size]) + 1, 0
        if count[w - size]:  # fills a window
            change = 1 - 2 * int(count[w - size])
            if change <= best:
                best, at = change, w - size
        if size < w - 1:
            here, there = count[1 : w - size], count[1 + size : w]
            change = np.where(here > 0, there - here, w * w)
            k = int(change.argmin())
            if here[k] and 2 * int(change[k]) + 2 < best:
                at = k + 1
        return at

    def _place(self, piece: Piece, size: int) -> None:
        level = self.best_level(size)
        pieces = self._pop(level) if level else []
        pieces.append(piece)
        self._push(level + size, pieces)
        while self.n_open > self.most_open:
            self._top_up()

    def _pop(self, level: int) -> list[Piece]:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _push(self, level: int, pieces: list[Piece]) -> None:
        if level == self.window:
            self.done.append(pieces)
        elif level:
            self.open.setdefault(level, []).append(pieces)
            self.levels[level] += 1
            self.n_open += 1

    def _top_up(self) -> None:
        """Fills the fullest open window with a part of the emptiest one; one fewer is open after."""
        taken = np.flatnonzero(self.levels)
        low, high = int(taken[0]), int(taken[-1])
        full, given = self._pop(high), self._pop(low)
        while high < self.window and given:
            moved, kept = _cut(given.pop(), self.window - high)
            size = len(moved[2]) // 4
            full.append(moved)
            high, low = high + size, low - size
            if kept:
                given.append(kept)
        self._push(high, full)
        self._push(low, given)

    def finish(self) -> None:
        """Closes all open windows; every sequence is then full or has a power of two as length."""
        windows = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.levels[:], self.n_open = {}, 0, 0
        first, last = 0, len(windows) - 1
        while first < last:
            level, pieces = windows[first]
            if level == self.window:
                self.done.append(pieces)
                first += 1
                continue
            rest, given = windows[last]
            moved, kept = _cut(given.pop(), min(self.window - level, rest))
            pieces.append(moved)
            size = len(moved[2]) // 4
            windows[first] = (level + size, pieces)
            if kept:
                given.append(kept)
            windows[last] = (rest - size, given)
            if rest == size:
                last -= 1
        if first == last and windows:
            self._powers(*windows[first])

    def _powers(self, level: int, pieces: list[Piece]) -> None:
        pieces = pieces[::-1]
        while level:
            size = 1 << (level.bit_length() - 1)
            level -= size
            out = []
            while size:
                moved, kept = _cut(pieces.pop(), size)
                out.append(moved)
                size -= len(moved[2]) // 4
                if kept:
                    pieces.append(kept)
            self.done.append(out)


def _cut(piece: Piece, size: int) -> tuple[Piece, Piece | None]:
    """The first ``size`` ids of a piece (or all), and the others if there are any."""
    doc, start, ids, n = piece
    if len(ids) <= 4 * size:
        return piece, None
    return (doc, start, ids[: 4 * size], n), (doc, start + size, ids[4 * size :], n)


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, end_id: int = END_ID, most_open: int = OPEN, special_as_text: bool = False) -> DataFrame:
    """One row for each piece: id, start, ids (little-endian unsigned 32-bit, binary), doc_tokens,
    sequence_id, offset, padded_to.

    Every id of every row's text, and ``end_id`` after it, lies in exactly one piece; a null or
    empty text has ``end_id`` alone. Rows are packed as they come, so repeated rows and ids are
    packed each. An empty table gives no rows. ``sequence_id`` holds the partition above bit 36. Columns
    other than these two are not read, so their names may be any. A very long text is cut into windows.
    The string of a special token gets its id, as the library does it, unless ``special_as_text``.
    """
    if window & (window - 1):
        raise ValueError("a window of a power of two")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    long, binary = T.LongType(), T.BinaryType()
    columns = [("start", long), ("ids", binary), ("doc_tokens", long), ("sequence_id", long), ("offset", long), ("padded_to", T.IntegerType())]
    schema = T.StructType([rows.schema["id"], *[T.StructField(n, t, False) for n, t in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer, special_as_text).encode_batch, Packer(window, most_open)
        end = np.array([end_id], "<u4").tobytes()
        base, number = TaskContext.get().partitionId() << 36, 0
        id_type = None

        def rows_of(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out = [[] for _ in range(7)]
            for pieces in sequences:
                offset, total = 0, sum(len(p[2]) for p in pieces) // 4
                padded = total if total & (total - 1) == 0 else window
                for doc, start, ids, n in pieces:
                    for column, value in zip(out, (doc, start, ids, n, base + number, offset, padded), strict=True):
                        column.append(value)
                    offset += len(ids) // 4
                number += 1
            i8, i4 = pa.int64(), pa.int32()
            arrays = [pa.array(c, t) for c, t in zip(out, (id_type, i8, pa.binary(), i8, i8, i8, i4), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["id", *[n for n, _ in columns]])

        for batch in batches:
            id_type = batch.column("id").type
            for doc, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text")), strict=True):
                packer.add(doc, ids + end)
                if len(packer.done) >= BATCH:
                    yield rows_of(packer.done)
                    packer.done = []
        if id_type is not None:
            packer.finish()
            for at in range(0, len(packer.done), BATCH):
                yield rows_of(packer.done[at : at + BATCH])

    return rows.mapInArrow(run, schema)


def digest_rows(pieces: DataFrame) -> DataFrame:
    """The query's columns of :func:`pack`'s rows."""
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the pieces of all documents with their places."""
    import public_tokenizers

    return digest_rows(pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
