"""Fuzzy line deduplication: SimHash and min-hash bands of normalised lines, verified edit similarity.

Every line with a word takes part. Lines below LEAST_WORDS words (also lines in scripts without spaces) link if their words
are equal, digits included. Longer ones link if their normalised texts are equal, or if they share a band, their fingerprints
differ by no more than LANE_BITS, and their normalised texts have edit similarity 0.8 or more (1 - distance / longer
length). Of each connected group one occurrence stays, that with the smallest (doc_id, line number).

At edit similarity 0.8 SimHashes differ in a dozen of 64 bits, and no pigeonhole blocks of such words are
selective. So blocks are cut from min-hashes, in which long words weigh more: their agreement follows the share
of letters in common, and the commonest words bring no strangers together. SimHash rules pairs out.

Cases: a null or empty text has no lines and stays as it is; rows without doc_id come after all others;
repeated rows are one document, so both keep the same lines; lines repeated inside a document go too;
ties go by line number; very long lines are compared whole; bytes that are no UTF-8 are read as U+FFFD;
an empty table gives no rows; other columns are kept. Equal lines are told by 128 bits of hash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.buckets import BUCKET, LEADING, band_sets, rest_fits
from tidewater.llm.common import Memo, components, mix64, persist, texts

LEAST_WORDS = 5
SIMILARITY = 0.8
#: Letters in equal words that make up four fifths of two lines are 0.667 of their letters in all: (1 - 0.667 ** BAND) ** BANDS = 3 %
#: of such pairs are missed, at every table size.
BAND, BANDS = 3, 10
#: Most bits in which fingerprints of two alike lines differ: at 0.667, 13 of 64 with a deviation of 3 (one in a thousand missed).
LANE_BITS = 23
#: Weight of a word by its length, as a power of two; longer ones weigh as the last.
WEIGHT = (0, 0, 0, 1, 2, 2, 3, 3, 3, 4)
#: Share of the longer line's letters that lie in words of both lines, below which an edit distance is not taken: at 0.5, two thirds
#: of such pairs share no band anyway.
COMMON = 0.5
#: Bins of words by which that share is bounded.
BINS = 256
#: Lines of candidate sets that a task compares together.
MEMBERS = 5_000
#: Characters that a task looks at together.
SLICE = 300_000
_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"\d+")
_LAST = (1 << 63) - 1
#: Columns beside those of the input while this operator works.
ROW, PLACE, GONE = "__line_row", "__line_place", "__lines_gone"


def folded(text: str) -> str:
    """Lower case, every run of digits as 0; lines stay lines."""
    return _NUMBER.sub("0", text.lower())


def normalise(line: str) -> str:
    """Words of a line, a space between."""
    return " ".join(_WORD.findall(folded(line)))


@cache
def _kinds() -> np.ndarray:
    """Of every code point: 0 outside words, 1 in words, 2 a digit."""
    every = [chr(c) for c in range(0x110000)]
    kinds = np.fromiter(map(str.isalnum, every), np.uint8, len(every))
    kinds[ord("_")] = 1
    kinds[np.fromiter(map(str.isdecimal, every), bool, len(every))] = 2
    return kinds


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2 ** 64, and their inverses."""
    base = 0x9E3779B97F4A7C15
    one = np.ones(n, np.uint64)
    one[1:] = base
    two = np.ones(n, np.uint64)
    two[1:] = pow(base, -1, 2**64)
    return np.cumprod(one), np.cumprod(two)


def line_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each line, hash of each word, length of each word) of a text, as `normalise` has them."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[c]
    digit = kind == 2
    if digit.any():
        keep = ~digit
        keep[0] = True
        keep[1:] |= ~digit[:-1]
        c, kind = np.where(digit, np.uint32(48), c)[keep], kind[keep]
    inside = np.zeros(len(c) + 2, np.int8)
    inside[1:-1] = kind > 0
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    new = np.flatnonzero(c == 10)
    size = 1 << max(19, int(len(c)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(0x632BE5AB)) * up[: len(c)], out=sums[1:])
    hashes = mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, new), [len(starts)]]))
    return counts, hashes, stops - starts


def prints(hashes: np.ndarray, lengths: np.ndarray, counts: np.ndarray, bands: int) -> np.ndarray:
    """A row of longs for each line of `counts` words: its SimHash, then a key for each band."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    shift = np.array(WEIGHT, np.uint64)[np.minimum(lengths, len(WEIGHT) - 1)]
    out = np.empty((len(counts), 1 + bands), np.uint64)
    weight = np.left_shift(1, shift.astype(np.uint8)).astype(np.uint8)
    above = np.zeros((len(counts), 64), np.int64)
    mixed = mix64(hashes + np.uint64(0xD1342543DE82EF95)).astype(">u8").view(np.uint8).reshape(-1, 8)
    ends, k = first + counts, 0
    while k < len(counts):  # lines of up to 8,000 words together; a longer line alone, in slices
        stop = max(k + 1, int(np.searchsorted(ends, first[k] + 8000, "right")))
        for s in range(int(first[k]), int(ends[stop - 1]), 8000):
            e = min(s + 8000, int(ends[stop - 1]))
            bits = np.unpackbits(mixed[s:e], axis=1) * weight[s:e, None]
            above[k:stop] += np.add.reduceat(bits, first[k:stop] - s if stop > k + 1 else [0], axis=0, dtype=np.int32)
        k = stop
    total = np.add.reduceat(weight, first, dtype=np.int64)
    out[:, 0] = np.packbits(2 * above > total[:, None], axis=1).view(">u8")[:, 0]
    out[:, 1:] = np.arange(bands, dtype=np.uint64)[None, :]
    for k in range(BAND * bands):
        least = np.minimum.reduceat((hashes * np.uint64((k + 1) * 0xD1342543DE82EF95 % 2**64 | 1)) >> shift, first)
        out[:, 1 + k % bands] = mix64(out[:, 1 + k % bands] * np.uint64(31) + least)
    return out.view(np.int64)


def _slices(docs: Iterator[tuple[int, int, str]]) -> Iterator[tuple[list[tuple[int, int, int, int]], str]]:
    """Texts joined to slices of about SLICE characters, cut between lines: ((row, doc_id, first line, lines) of each part, slice)."""
    where, parts, size = [], [], 0
    for row, doc, text in docs:
        start = line = 0
        while True:
            stop = len(text)
            if stop - start > SLICE:
                stop = text.rfind("\n", start, start + SLICE)
                stop = stop if stop >= start else text.find("\n", start + SLICE)
                stop = stop if stop >= 0 else len(text)
            part = text[start:stop]
            lines = part.count("\n") + 1
            where.append((row, doc, line, lines))
            parts.append(part)
            size += len(part) + 1
            if size >= SLICE:
                yield where, "\n".join(parts)
                where, parts, size = [], [], 0
            if stop == len(text):
                break
            line += lines
            start = stop + 1
    if parts:
        yield where, "\n".join(parts)


def line_prints(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """(row, doc_id, line_no, line, check, print): lines that take part, `line` and `check` their hashes.

    `print` has the fingerprint and the bands; it is null for short lines, and where the same task has given it just before.
    """
    names = ["row", "doc_id", "line_no", "line", "check", "print"]
    c1, c2, c3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True)
            docs = ((row, _LAST if doc is None else doc, raw.decode("utf-8", "replace")) for row, doc, raw in rows)
            for where, text in _slices(docs):
                counts, hashes, lengths = line_words(text)
                of = np.flatnonzero(counts)
                if not len(of):
                    continue
                counts = counts[of]
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                place = (np.arange(len(hashes)) - np.repeat(first, counts)).astype(np.uint64)
                line = np.add.reduceat(mix64(hashes + place * c1), first)
                check = np.add.reduceat(mix64((hashes ^ c3) + place * c2), first)
                long = counts >= LEAST_WORDS
                if not long.all():
                    split, short = text.split("\n"), np.flatnonzero(~long)
                    own = [xxhash.xxh3_128_intdigest(" ".join(_WORD.findall(split[i].lower()))) for i in of[short].tolist()]
                    line[short], check[short] = ([d >> k & 0xFFFFFFFFFFFFFFFF for d in own] for k in (64, 0))
                _, new = np.unique(line ^ mix64(check), return_index=True)
                fresh = np.zeros(len(line), bool)
                fresh[new] = True
                fresh &= long
                words = np.repeat(fresh, counts)
                found = prints(hashes[words], lengths[words], counts[fresh], bands) if fresh.any() else np.empty((0, bands + 1), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.cumsum(fresh) - fresh, [int(fresh.sum())]]) * (bands + 1), pa.int32()), pa.array(found.reshape(-1)), mask=pa.array(~fresh))
                # the part that a line of the slice is from, and its number there
                row, doc, base, lines = (np.array(x, np.int64) for x in zip(*where, strict=True))
                starts = np.cumsum(lines) - lines
                part = np.searchsorted(starts, of, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(row[part]), pa.array(doc[part]), pa.array((of - starts[part] + base[part]).astype(np.int32)), pa.array(line.view(np.int64)), pa.array(check.view(np.int64)), lists], names)

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, line_no int, line long, check long, print array<long>")


def candidates(lines: DataFrame, rows: int, bucket: int = BUCKET) -> DataFrame:
    """(lines): sets of lines, each connected by a shared band and near fingerprints. Links lie inside one set, but for those of large
    buckets that are left to `rest_fits`.

    lines: (line, print) of about `rows` different lines; a line may come again.
    """
    return _candidates(lines, rows, bucket)[0]


def _candidates(lines: DataFrame, rows: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """The candidates, and the chunks of large buckets, whose lines may have further links."""
    sets, chunks = band_sets(lines.where("print is not null").select(F.col("line").alias("id"), "print"), rows * BANDS, LANE_BITS, bucket)
    return sets.select(F.col("members").alias("lines")), chunks


def same_ends(a: str, b: str) -> tuple[int, int]:
    """Characters of the longest common prefix and, after it, suffix of a and b."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    front, low, high = low, 0, min(len(a), len(b)) - low
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[-mid:] == b[-mid:] else (low, mid - 1)
    return front, low


def trimmed(a: str, b: str) -> tuple[str, str]:
    """a and b without their longest common prefix and, then, suffix."""
    front, back = same_ends(a, b)
    return a[front : len(a) - back], b[front : len(b) - back]


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance of one pair by bit vectors (Hyyrö 2003), or most + 1 when it is larger."""
    a, b = trimmed(a, b)
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    full = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, size, top = full, 0, len(a), 1 << (len(a) - 1)
    for k, c in enumerate(b):
        eq = at.get(c, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        h, v = down | (full & ~(d | up)), up & d
        if h & top:
            size += 1
        elif v & top:
            size -= 1
        h, v = (h << 1 | 1) & full, v << 1 & full
        up, down = v | (full & ~(d | h)), h & d
        if size - (len(b) - 1 - k) > most:
            return most + 1
    return size


def most_edits(a: str, b: str) -> int:
    return int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)


def alike(a: str, b: str) -> bool:
    most = most_edits(a, b)
    return edit_distance(a, b, most) <= most


def gaps(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """What differs between two lines of words, once words that occur once in each line are matched in order, as many as can be."""
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    ours, theirs = dict(zip(a, range(len(a)), strict=True)), dict(zip(b, range(len(b)), strict=True))
    if len(ours) < len(a) or len(theirs) < len(b):
        often = {w for line in (a, b) for w, n in Counter(line).items() if n > 1}
        ours = {w: i for w, i in ours.items() if w not in often}
    tails: list[int] = []  # least last places of increasing sequences
    ends: list[tuple[int, int, tuple | None]] = []
    for w, i in ours.items():
        j = theirs.get(w)
        if j is not None:
            k = bisect_left(tails, j)
            link = (i, j, ends[k - 1] if k else None)
            tails[k : k + 1], ends[k : k + 1] = [j], [link]
    out, i, j = [], len(a), len(b)
    link = ends[-1] if ends else None
    while True:
        x, y = (link[0], link[1]) if link else (-1, -1)
        while i - 1 > x and j - 1 > y and a[i - 1] == b[j - 1]:  # equal words beside matched ones
            i, j = i - 1, j - 1
        if i - 1 > x or j - 1 > y:
            # a gap that is empty on one side takes along the space that parts words
            out.append((" ".join(a[x + 1 : i]) + " " * (j - 1 == y), " ".join(b[y + 1 : j]) + " " * (i - 1 == x)))
        if link is None:
            return out
        i, j, link = x, y, link[2]


def gap_distance(a: list[str], b: list[str], most: int) -> int:
    """An upper bound of the edit distance of two lines of words, or more than `most`: the edit distances of their gaps.

    It exceeds the distance only where the best way to edit does not keep the matched words.
    """
    parts = gaps(a, b)
    total = sum(max(len(x), len(y)) for x, y in parts)
    if total <= most:
        return total
    least = sum(abs(len(x) - len(y)) for x, y in parts)
    for x, y in parts:
        if least > most:
            break
        d = abs(len(x) - len(y))
        least += edit_distance(x, y, most - least + d) - d
    return least


def letters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, as `normalise` has it: its length, and its letters (with the space after each word) in bins of words."""
    size, bins, s = np.zeros(len(lines), np.int64), np.zeros((len(lines), BINS), np.float32), 0
    while s < len(lines):
        e, n = s + 1, len(lines[s])
        while e < len(lines) and n + len(lines[e]) < SLICE:
            n, e = n + len(lines[e]) + 1, e + 1
        counts, hashes, lengths = line_words("\n".join(lines[s:e]))
        at = np.repeat(np.arange(e - s) * BINS, counts) + (hashes % np.uint64(BINS)).astype(np.int64)
        part = np.bincount(at, lengths + 1, (e - s) * BINS).reshape(-1, BINS)
        size[s:e], bins[s:e], s = part.sum(1) - 1, part, e
    return size, bins


def bounded_distance(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance of two normalised lines, or more than `most`.

    What lies between equal ends is bounded by its length, else by `gap_distance` of its whole words.
    """
    front, back = same_ends(a, b)
    bound = max(len(a), len(b)) - front - back
    if bound <= most:
        return bound
    front = a.rfind(" ", 0, front) + 1
    back = len(a) - x if back and (x := a.find(" ", len(a) - back)) >= 0 else 0
    return gap_distance(a[front : len(a) - back].split(" "), b[front : len(b) - back].split(" "), most)


def within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """For each (a, b, most), whether the Levenshtein distance of a and b is `most` or less.

    Equal ends go first. The rest is looked at together, in order of length: anti-diagonals of the table, in the
    band that a path of `most` edits can reach (Ukkonen 1985); pairs that have left the bound go.
    """
    out = np.zeros(len(pairs), bool)
    rest: list[tuple[int, str, str, int]] = []
    for k, (a, b, most) in enumerate(pairs):
        a, b = trimmed(a, b)
        if max(len(a), len(b)) <= most:
            out[k] = True
        elif abs(len(a) - len(b)) <= most:
            rest.append((k, a, b, most))
    rest.sort(key=lambda x: len(x[1]))
    s = 0
    while s < len(rest):
        n = min(len(rest) - s, 256)
        n = max(1, min(n, 1_000_000 // len(rest[s + n - 1][1])))
        _banded(rest[s : s + n], out)
        s += n
    return out


def _banded(part: list[tuple[int, str, str, int]], out: np.ndarray) -> None:
    at, most = np.array([k for k, _, _, _ in part]), np.array([m for _, _, _, m in part])
    one, two = np.array([len(a) for _, a, _, _ in part]), np.array([len(b) for _, _, b, _ in part])
    k = int(((most + np.abs(one - two)) // 2).max()) // 2 * 2 + 2  # diagonals -k to k, k even
    longest = int(max(one.max(), two.max()))
    kind = np.int16 if longest < 8000 else np.int32
    far = 4 * (longest + k) if kind is np.int32 else 20_000
    width = longest + 2 * k + 2
    # a's place i lies in column k + i, b's place j in column width - 1 - k - j: along an anti-diagonal both rise
    a, b = np.full((len(part), width), 0xFFFFFFFF, np.uint32), np.full((len(part), width), 0xFFFFFFFE, np.uint32)
    for r, (_, x, y, _) in enumerate(part):
        a[r, k + 1 : k + 1 + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        b[r, width - 1 - k - len(y) : width - 1 - k] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1]
    even, odd = np.full((len(part), k + 1), far, kind), np.full((len(part), k + 2), far, kind)  # odd: one more at each end
    even[:, k // 2] = 0
    end = one + two
    for step in range(1, int(end.max()) + 1):
        low = -k if step % 2 == 0 else 1 - k  # the first diagonal
        n = k + 1 if step % 2 == 0 else k
        i, j = (step + low) // 2, (step - low) // 2
        x, y = k + i, width - 1 - k - j
        x0, x1 = max(0, -x, -y), min(n, width - x, width - y)  # cells whose places exist in both; the others stay far
        new, other = (even, odd) if step % 2 == 0 else (odd[:, 1:-1], even)
        best = np.minimum(other[:, x0:x1], other[:, x0 + 1 : x1 + 1])
        best += 1
        part_ = new[:, x0:x1]
        part_ += a[:, x + x0 : x + x1] != b[:, y + x0 : y + x1]
        np.minimum(part_, best, out=part_)
        if step <= k:  # the table's edges
            new[:, (-step - low) // 2] = new[:, (step - low) // 2] = step
        ended = end == step
        if ended.any():
            out[at[ended]] = new[ended, (one[ended] - two[ended] - low) // 2] <= most[ended]
        if step % 16 == 0 or ended.any():
            keep = ~ended & (np.minimum(even.min(1), odd.min(1)) <= most)
            if not keep.all():
                if not keep.any():
                    return
                at, most, one, two, end, a, b, even, odd = (v[keep] for v in (at, most, one, two, end, a, b, even, odd))


class Groups(dict):
    """Connected groups of lines that a task has seen, forgotten beyond `most` lines: only pairs compared twice then come again."""

    most = 300_000

    def __missing__(self, line: int) -> int:
        self[line] = line
        return line

    def find(self, line: int) -> int:
        while (up := self[line]) != line:
            self[line] = self[up]
            line = self[up]
        return line

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart until now."""
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _near(size: np.ndarray, bins: np.ndarray, at: np.ndarray, counts: np.ndarray, p: np.ndarray | None = None, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set, place, place) of pairs inside sets of `counts` members `at` that lengths and letters in common let be alike; where
    fingerprints and groups are given, only of near ones in different groups."""
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(counts)), counts)
    later = ends[of] - np.arange(len(at)) - 1  # members of the same set after each one
    total = np.concatenate([[0], np.cumsum(later)])
    s = 0
    while s < len(at):
        e = max(s + 1, int(np.searchsorted(total, total[s] + 200_000, "right")) - 1)
        i = np.repeat(np.arange(s, e), later[s:e])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[s])
        if p is not None:
            ok = (root[i] != root[j]) & (np.bitwise_count((p[i] ^ p[j]).view(np.uint64)) <= LANE_BITS)
            i, j = i[ok], j[ok]
        no, i, j = of[i], at[i], at[j]
        longer = np.maximum(size[i], size[j])
        ok = np.abs(size[i] - size[j]) <= (1 - SIMILARITY) * longer + 1e-9
        no, i, j, longer = no[ok], i[ok], j[ok], longer[ok]
        both = [np.minimum(bins[i[k : k + 256]], bins[j[k : k + 256]]).sum(1) for k in range(0, len(i), 256)]
        if both:
            ok = np.concatenate(both) >= COMMON * longer
            yield no[ok], i[ok], j[ok]
        s = e


def _edges(sets: list[list[dict]], plain: Memo, groups: Groups) -> list[tuple[int, int]]:
    """Alike lines of the sets that `groups` did not connect yet: a spanning forest of each set, together with what came before."""
    if len(groups) > groups.most:
        groups.clear()
    text = {x["line"]: x["text"] for lines in sets for x in lines}
    line, raw = list(text), list(text.values())
    place = {x: k for k, x in enumerate(line)}
    size, bins = letters(raw)
    counts = np.array([len(lines) for lines in sets])
    at = np.array([place[x["line"]] for lines in sets for x in lines])
    edges: list[tuple[int, int]] = []
    waiting: dict[int, list[tuple[int, int]]] = {}

    def join(x: int, y: int) -> None:
        if groups.join(line[x], line[y]):
            edges.append((line[x], line[y]))

    marks = [np.array([x[c] for lines in sets for x in lines], np.int64) if "root" in sets[0][0] else None for c in ("p", "root")]
    if marks[1] is not None:
        for x, root in zip(at.tolist(), marks[1].tolist(), strict=True):
            groups.join(line[x], root)  # known links
    for no, i, j in _near(size, bins, at, counts, *marks):
        for s, x, y in zip(no.tolist(), i.tolist(), j.tolist(), strict=True):
            if groups.find(line[x]) != groups.find(line[y]):
                a, b = plain[raw[x]], plain[raw[y]]
                most = most_edits(a, b)
                bound = bounded_distance(a, b, most + most // 8)
                if bound <= most:
                    join(x, y)
                elif bound <= most + most // 8:
                    waiting.setdefault(s, []).append((x, y))  # too near to leave it at a bound
    while waiting:  # each time, of each set as many pairs as it has lines; pairs that are connected meanwhile are skipped
        asked, later = [], {}
        for s, rest in waiting.items():
            rest = [(x, y) for x, y in rest if groups.find(line[x]) != groups.find(line[y])]
            asked += rest[: counts[s]]
            if rest[counts[s] :]:
                later[s] = rest[counts[s] :]
        asked = list(dict.fromkeys(asked))
        pairs = [(plain[raw[x]], plain[raw[y]]) for x, y in asked]
        for (x, y), yes in zip(asked, within([(a, b, most_edits(a, b)) for a, b in pairs]).tolist(), strict=True):
            if yes:
                join(x, y)
        waiting = later
    return edges


def line_texts(lines: DataFrame, leads: DataFrame, docs: DataFrame) -> DataFrame:
    """(line, text) of the lines in column `line`, on disk: the shuffle that brought them goes before the next one."""
    wanted = lines.select("line").distinct().join(leads, "line").select("line", "lead.row", "lead.doc_id", "lead.line_no")
    by_row = wanted.groupBy("row", "doc_id").agg(F.collect_list(F.struct("line_no", "line")).alias("want"))
    taken = by_row.join(docs.select("row", F.col("place").alias("doc_id"), "text"), ["row", "doc_id"]).select(F.split("text", "\n", -1).alias("parts"), F.explode("want").alias("w"))
    return persist(taken.select(F.col("w.line").alias("line"), F.element_at("parts", F.col("w.line_no") + 1).alias("text")).dropDuplicates(["line"]), "line-texts")


def marks(held: DataFrame) -> DataFrame:
    """(id, size, bins) of lines (line, text): length and letters in bins of words, as `letters` has them, in a byte each (255 for any more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.decode("utf-8", "replace") for x in texts(batch.column("text"))]
            for s in range(0, len(raw), 2000):
                size, bins = letters(raw[s : s + 2000])
                rows = np.minimum(bins, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("line")[s : s + 2000], pa.array(size.astype(np.int32)), pa.array([x.tobytes() for x in rows], pa.binary())], ["id", "size", "bins"])

    return held.select("line", "text").mapInArrow(run, "id long, size int, bins binary")


def verified(sets: DataFrame, leads: DataFrame, docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between alike lines in a set: a spanning forest of each set, pairs already connected are skipped.

    Small sets with the same first two lines are dealt to one task, as many of their pairs are the same. Larger ones,
    among them the chunks of one large bucket with the same leading rows, are dealt one by one. Sets of `rest_fits` bring
    fingerprints and groups along: of these only near lines of different groups are compared. `held`: texts of the lines, if there are.
    """
    deal = F.when(F.size("lines") < LEADING, F.xxhash64(F.slice("lines", 1, 2))).otherwise(F.xxhash64("lines"))
    extra = [c for c in ("p", "root") if c in sets.columns]
    numbered = persist(sets.select(deal.alias("deal"), F.xxhash64("lines").alias("set"), F.col("lines").alias("line"), *extra), "line-sets")
    members = numbered.select("deal", "set", F.explode(F.arrays_zip("line", *extra)).alias("m")).select("deal", "set", *[f"m.{c}" for c in ("line", *extra)])
    held = line_texts(members, leads, docs) if held is None else held
    whole = members.join(held, "line").repartition("deal").groupBy("deal", "set").agg(F.collect_list(F.struct("line", "text", *extra)).alias("lines"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, groups = Memo(normalise, 20_000), Groups()
        for batch in batches:
            lists = batch.column("lines")
            total = lists.offsets.to_numpy()
            s = 0
            while s < batch.num_rows:  # whole sets, of some thousands of lines together
                e = max(s + 1, int(np.searchsorted(total, total[s] + MEMBERS, "right")) - 1)
                edges, s = _edges(lists[s:e].to_pylist(), plain, groups), e
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], ["a", "b"])

    return whole.select("lines").mapInArrow(compare, "a long, b long").distinct()


def dedup_lines(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs with `text` rewritten, plus n_lines and n_removed (lines of the input and lines removed).

    Input columns of those two names are replaced.
    """
    rows = docs.withColumn(ROW, F.xxhash64("doc_id", F.xxhash64("text"))).withColumn(PLACE, F.coalesce("doc_id", F.lit(_LAST)))
    plain = rows.select(F.col(ROW).alias("row"), F.col(PLACE).alias("place"), "doc_id", "text")
    lines = persist(line_prints(plain), "lines")
    lead = F.min(F.struct("doc_id", "line_no", "row")).alias("lead")
    distinct = persist(lines.groupBy("line", "check").agg(lead, F.count("*").alias("n")), "distinct-lines")
    leads = distinct.select("line", "lead")
    sets, chunks = _candidates(lines, distinct.count(), bucket)
    if chunks.isEmpty():
        groups = components(verified(sets, leads, plain), "lines")
    else:
        edges = persist(verified(sets, leads, plain), "line-edges")
        held = line_texts(chunks.select(F.explode("ids").alias("line")), leads, plain)
        rest = persist(rest_fits(chunks, components(edges, "lines"), marks(held), LANE_BITS, SIMILARITY, COMMON), "line-rest")
        groups = components(edges.unionAll(verified(rest.withColumnRenamed("members", "lines"), leads, plain, held)), "lines")
    placed = distinct.select("line", "check", "lead", "n").join(groups, F.col("line") == F.col("node"), "left").select("line", "check", "lead", "n", F.coalesce("root", "line").alias("root"), F.when(F.col("root").isNull(), F.col("check")).alias("apart"))
    many = persist(placed.where("n > 1 or apart is null"), "line-groups")
    firsts = many.groupBy("root", "apart").agg(F.min("lead").alias("first"))
    keep = many.alias("m").join(firsts.alias("f"), F.expr("m.root = f.root and m.apart <=> f.apart")).select("m.line", "m.check", "f.first")
    gone = lines.select("line", "check", "doc_id", "line_no", "row").join(keep, ["line", "check"]).where(F.struct("doc_id", "line_no", "row") != F.col("first"))
    removed = gone.groupBy(F.col("row").alias(ROW), F.col("doc_id").alias(PLACE)).agg(F.collect_set("line_no").alias(GONE))
    parts = F.split("text", "\n", -1)
    out = rows.drop("n_lines", "n_removed").join(removed, [ROW, PLACE], "left")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(GONE, i)), "\n")
    return out.select(
        *[F.when(F.col(GONE).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.coalesce(F.size(GONE), F.lit(0)).alias("n_removed"),
    )
