"""Packing documents into fixed windows by best-fit decreasing.

Cases: a null text counts as empty and gives the closing id alone; a null doc_id is packed like any
other; repeated rows are packed once each; ties go by doc_id and start; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import array
import base64
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import texts

END_ID = 0
#: Pieces of one packing group: enough for a close fit, few enough for one task.
GROUP_ROWS = 6000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, equal to those of the named vocabulary file.

    Where the same vocabulary lies beside it as a rank file, texts of Latin letters without special
    tokens take that faster encoder; all others go to the vocabulary's own tokenizer.
    """

    def __init__(self, path: str, special: str = "<|endoftext|>"):
        import public_tokenizers

        self.path, self._own = path, None
        self.other = re.compile(f"[^\x00-\u024f]|{re.escape(special)}")
        self.fast = None
        rank_file = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(rank_file):
            import tiktoken

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or self.other.search(text):
            if self._own is None:
                from tokenizers import Tokenizer

                self._own = Tokenizer.from_file(self.path)
            ids = self._own.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        raw = array.array("I", ids)
        if sys.byteorder == "big":
            raw.byteswap()
        return raw.tobytes()


def pieces(docs: DataFrame, window: int = 1024, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids plus the closing id into full windows and one shorter rest.

    Rows: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian uint32).
    """
    path = path or vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for doc, text in zip(ids, texts(batch.column("text")), strict=True):
                raw = encode(text.decode("utf-8", "replace")) + end
                total = len(raw) // 4
                for s in range(0, total, window):
                    part = raw[4 * s : 4 * (s + window)]
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), total, *([part] if with_ids else [])))
            for s in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 20_000], strict=True), kinds, strict=True)], names)

    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)]
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class OpenWindows:
    """Open windows by what still fits; a segment tree finds the tightest that takes a piece."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.begun = 0

    def _add(self, room: int, by: int) -> None:
        x = room + self.size
        while x:
            self.count[x] += by
            x >>= 1

    def push(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with least room of at least length: climb to the first right branch in use, then descend left."""
        x = length + self.size
        if not self.count[x]:
            while x > 1 and (x & 1 or not self.count[x + 1]):
                x >>= 1
            if x <= 1:
                return None
            x += 1
            while x < self.size:
                x = 2 * x if self.count[2 * x] else 2 * x + 1
        room = x - self.size
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int, free: OpenWindows | None = None) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; lengths come longest first. `free` carries on from earlier ones."""
    free, sequences, offsets = free or OpenWindows(window), [], []
    for length in lengths:
        found = free.take(length) if length < window else None
        if found is None:
            room, sequence = window, free.begun
            free.begun += 1
        else:
            room, sequence = found
        sequences.append(sequence)
        offsets.append(window - room)
        if room > length:
            free.push(room - length, sequence)
    return sequences, offsets


def pack(cut: DataFrame, rows: int, window: int = 1024, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack pieces of at most `window` ids; adds sequence_id and offset.

    `rows` (about the number of pieces) sets how many groups there are. Pieces are dealt to groups in turn, so that
    groups are even and equal rows spread too; each group is packed longest first, leaving a few open windows in each.
    """
    names = cut.columns

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free, base = OpenWindows(window), TaskContext.get().partitionId() << 32
        for batch in batches:
            sequences, offsets = best_fit(batch.column("length").to_pylist(), window, free)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(sequences, np.int64) + base), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    dealt = cut.repartition(max(1, -(-rows // group_rows))).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(fit, ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, window: int = 1024, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents."""
    # pieces are counted from rows and bytes, about four to a token, so that a few very long documents are not packed by one task
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return pack(pieces(docs, window, path, with_ids), size["rows"] + size["bytes"] // (4 * window), window)
