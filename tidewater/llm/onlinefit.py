"""Packing documents into fixed windows as they come, with a bounded number of open bins.

Pieces stream through each task once; a task holds `most_open` bins and nothing else, so that its memory
doesn't grow with its rows.

Cases: a null text counts as empty and gives the closing id alone; a null doc_id is packed like any
other; repeated rows are packed once each and dealt evenly over tasks; a text of exactly one window stays
whole; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import texts
from tidewater.llm.packing import Encoder, vocabulary

END_ID = 2
#: Bins that are open at one time.
MOST_OPEN = 256
#: Pieces of one task, about: each task leaves some open bins behind, and only these are filled less.
TASK_PIECES = 25_000


def spans(total: int, window: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document: full windows, with what is over first."""
    start, length = 0, total % window or min(total, window)
    while start < total:
        yield start, length
        start, length = start + length, window


def pieces(docs: DataFrame, window: int = 1024, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents longer than a window are cut, all others stay whole.

    Rows: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian uint32).
    """
    path = path or vocabulary()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                raw = encode(text.decode("utf-8", "replace")) + end
                for k, (start, length) in enumerate(spans(len(raw) // 4, window)):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part), *([part] if with_ids else [])))
            for s in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 20_000], strict=True), kinds, strict=True)], names)

    types = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return docs.select("doc_id", "text").mapInArrow(cut, ", ".join(f"{n} {types[t]}" for n, t in zip(names, kinds, strict=True)))


class OpenBins:
    """At most `most` open bins by the room left in them: a bit for each room in use, and the bins of that room.

    The lowest bit at or above a length is the best fit; the lowest bit of all is the fullest bin.
    """

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.rooms, self.open, self.bins = 0, 0, [[] for _ in range(window + 1)]
        self.begun = 0

    def _take(self, room: int) -> int:
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.rooms ^= 1 << room
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of that length."""
        fits = self.rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = self._take(room)
        else:
            room, at = self.window, self.begun
            self.begun += 1
        if room > length:
            left = room - length
            self.bins[left].append(at)
            self.rooms |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.rooms & -self.rooms).bit_length() - 1)
        return at, self.window - room


def pack(cut: DataFrame, rows: int, window: int = 1024, most_open: int = MOST_OPEN, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Pack pieces of at most `window` ids; adds sequence_id and offset.

    `rows` (about the number of pieces) sets the number of tasks. Pieces are dealt in turn, so that equal
    rows spread too; within a task a hash orders them, so that a task that is repeated packs as before.
    """
    names = cut.columns

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(window, most_open), TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                placed = np.array([bins.place(n) for n in batch.column("length").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed[:, 0] + base), pa.array(placed[:, 1])], [*names, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    dealt = cut.repartition(max(1, -(-rows // task_pieces))).sortWithinPartitions(order, "doc_id", "piece", "length", "ids_crc32")
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id bigint, offset bigint"
    return dealt.mapInArrow(fit, schema)


def pack_documents(docs: DataFrame, window: int = 1024, path: str | None = None, with_ids: bool = False, most_open: int = MOST_OPEN, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Tokenise and pack whole documents."""
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return pack(pieces(docs, window, path, with_ids), size["rows"] + size["bytes"] // (4 * window), window, most_open, task_pieces)
