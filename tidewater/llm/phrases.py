"""Phrases whose words stand together more often than by chance, for each language.

N-grams become rows (lang, phrase, n) level by level, from one word to max_n. A phrase is no more
frequent than its parts, so that level n takes only n-grams whose two parts of n - 1 words are frequent;
tasks tell those by a bitmap of bounded size. A bit set by another phrase lets a rare n-gram through,
which its count then rules out: nothing is lost at any size. Counts, joins, scores and ranks are DataFrame
steps; scores are decimals.

Cases: a null text is empty; a null language is `und`; empty pieces and blanks give no words; repeated
rows count again; a long text is cut at the end of a piece, or between words that are then read again where
a piece is longer than a slice; equal scores go by count, then phrase; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import Memo, mix64, persist, texts

#: Bytes of text that are cut into words at one time.
SLICE = 1 << 22
#: The bitmap has 16 bits for each frequent phrase, within these bounds (1 MB and 32 MB).
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 28

#: Fixed by the contract: A to Z change, these marks end a piece, tabs are blanks.
_PLAIN = bytes(b | 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def slices(text: bytes, again: int, most: int = SLICE) -> Iterator[bytes]:
    """A text of words, blanks and line ends in parts of about `most` bytes; within a piece a part starts
    with the last `again` words of the one before."""
    at, tail = 0, b""
    while len(text) - at > most:
        end = text.rfind(b"\n", at, at + most)
        if end > at:
            yield tail + text[at:end]
            at, tail = end + 1, b""
            continue
        ends = [e for e in (text.find(b" ", at + most), text.find(b"\n", at + most)) if e >= 0]
        if not ends:
            break
        end = min(ends)
        part = tail + text[at:end]
        yield part
        last = part.rpartition(b"\n")[2].split(b" ")
        words = [w for w in last if w][-again:] if again else []
        tail = b" ".join([*words, b""]) if words and text[end] != 10 else b""
        at = end + 1
    yield tail + text[at:]


def words(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a slice as a dictionary array, and the number of the piece each lies in."""
    raw = np.frombuffer(text, np.uint8)
    ends_piece = raw == 10
    letter = np.concatenate(([False], (raw != 32) & ~ends_piece, [False]))
    change = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = change[::2], change[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letter[1:-1]])])
    return array.dictionary_encode(), np.searchsorted(np.flatnonzero(ends_piece), starts)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def phrase_hashes(columns: list[np.ndarray], lang: str | None) -> np.ndarray:
    """Hashes of phrases from the hashes of their words, first words first."""
    h = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for column in columns:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


class Bitmap:
    """Which phrases may be frequent: two bits for each that is."""

    def __init__(self, bits: int, held: bytes | None = None):
        self.bits = bits
        self.held = None if held is None else np.frombuffer(held, np.uint64)

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [(h >> np.uint64(s)) & np.uint64(self.bits - 1) for s in (0, 32)]

    def __contains__(self, h):
        raise TypeError("ask for many at once")

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h):
            out &= (self.held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bitmap(frequent: DataFrame, count: int) -> Bitmap:
    """The bitmap of the frequent phrases (lang, phrase): bits are set in tasks and merged by a bit-wise or."""
    size = Bitmap(min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length())))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Memo(_word_hash)
        for batch in batches:
            by_shape: dict[tuple, list] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), texts(batch.column("phrase")), strict=True):
                parts = phrase.split(b" ")
                by_shape.setdefault((lang, len(parts)), []).append([hashes[w] for w in parts])
            for (lang, _), rows in by_shape.items():
                at = np.concatenate(size.places(phrase_hashes(list(np.array(rows, np.uint64).T), lang)))
                bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["slot", "bits"])

    merged = frequent.select("lang", "phrase").mapInArrow(mark, "slot long, bits long").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    held = np.zeros(size.bits // 64, np.int64)
    held[merged.column("slot").to_numpy()] = merged.column("bits").to_numpy()
    return Bitmap(size.bits, held.tobytes())


def grams(docs: DataFrame, size: int, parts: Bitmap | None = None) -> DataFrame:
    """N-grams of `size` words as rows (lang, phrase, n), summed over slices of text.

    For single words a row without phrase gives the number of all words of a slice.
    """
    held = docs.sparkSession.sparkContext.broadcast((parts.bits, parts.held.tobytes())) if parts else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Bitmap(*held.value) if held else None
        hashes = Memo(_word_hash)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
                by_lang.setdefault("und" if lang is None else lang, []).append(text)
            for lang, group in by_lang.items():
                for text in _joined(group, size - 1):
                    found = _singles(text) if size == 1 else _grams(text, lang, size, frequent, hashes)
                    if found is not None:
                        phrases, n = found
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), phrases.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, n long")


def _joined(group: list[bytes], again: int) -> Iterator[bytes]:
    """Short texts together, long ones in slices."""
    held, room = [], SLICE
    for text in group:
        for part in slices(text.translate(_PLAIN), again):
            held.append(part)
            room -= len(part)
            if room <= 0:
                yield b"\n".join(held)
                held, room = [], SLICE
    if held:
        yield b"\n".join(held)


def _singles(text: bytes) -> tuple[pa.Array, np.ndarray] | None:
    coded, _ = words(text)
    if not len(coded):
        return None
    n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
    return pa.concat_arrays([coded.dictionary, pa.array([None], pa.binary())]), np.append(n, n.sum())


def _grams(text: bytes, lang: str, size: int, frequent: Bitmap, hashes: Memo) -> tuple[pa.Array, np.ndarray] | None:
    coded, piece = words(text)
    total = len(coded) - size + 1
    if total < 1:
        return None
    index = coded.indices.to_numpy().astype(np.int64)
    own = np.array([hashes[w] for w in coded.dictionary.to_pylist()], np.uint64)[index]
    part = frequent.may_hold(phrase_hashes([own[k : k + total + 1] for k in range(size - 1)], lang))
    at = np.flatnonzero(part[:-1] & part[1:] & (piece[:total] == piece[size - 1 :]))
    if not len(at):
        return None
    # equal n-grams get one number, a word at a time
    number, lead = index[at], np.arange(len(at))
    for k in range(1, size):
        _, lead, number, n = np.unique(number * len(coded.dictionary) + index[at + k], return_index=True, return_inverse=True, return_counts=True)
    picked = [coded.dictionary.take(pa.array(index[at[lead] + k])) for k in range(size)]
    return pc.binary_join_element_wise(*picked, pa.scalar(b" ", pa.binary())), n


def phrase_counts(docs: DataFrame, max_n: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Frequent n-grams of every size (lang, phrase, size, a), and the number of words of each language (lang, n)."""
    levels, parts, total = [], None, None
    for size in range(1, max_n + 1):
        summed = grams(docs, size, parts).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        level = persist(summed.where((F.col("a") >= least) | F.col("phrase").isNull()), f"phrases-{size}")
        if total is None:
            total = level.where("phrase is null").select("lang", F.col("a").alias("n"))
            level = level.where("phrase is not null")
        levels.append(level.select("lang", "phrase", F.lit(size).alias("size"), "a"))
        if size < max_n:
            held = level.count()
            if not held:
                break
            parts = bitmap(level, held)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionAll(level)
    return persist(every, "phrases"), total


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """The highest-scoring phrases of 2 to max_n words of each language.

    Rows: lang, rank, phrase, a, l, r, n, score.
    """
    counts, total = phrase_counts(docs, max_n, least)
    candidates = counts.where("size > 1")
    longer = candidates.where("size > 2")
    drop_last, drop_first = F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)")
    covered = longer.select("lang", F.explode(F.array(drop_last, drop_first)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    # no phrase is more frequent than a part of it: one more word with the same count covers, and so would any longer one
    kept = candidates.join(covered, ["lang", "phrase"], "left").where("most is null or 100 * most < 100 * a").drop("most")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).selectExpr(
        "*", "substring_index(phrase, ' ', k) AS first", "substring_index(phrase, ' ', k - size) AS rest"
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        cut.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .join(total, "lang")
        .withColumn("over", (F.lit(1000).cast("decimal(4,0)") * big("a") * F.col("n").cast("decimal(14,0)")).cast("decimal(38,0)"))
        .withColumn("under", (big("l") * big("r")).cast("decimal(38,0)"))
        .withColumn("score", F.expr("over div under"))
    )
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
