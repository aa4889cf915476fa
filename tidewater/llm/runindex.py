"""Repeated passages by a run-length index: byte-exact removal of long strings seen in earlier documents.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id. Work is dealt by content, not by document:

1. Every window of `length` bytes has an anchor, its least 16-byte hash, so equal windows have equal
   anchors. Chunks of documents send their distinct anchors to buckets, which say which occur twice.
2. Around those anchors, chunks send the segments that hold all their windows. A bucket sorts the
   suffixes of its distinct segments, keeps the Burrows-Wheeler transform as runs with the text
   positions of run ends, and streams every segment against it: matching statistics give each window
   its length and a place, and the place the smallest doc_id of that window.
3. Chunks mark the windows whose smallest doc_id is below their own.

Cases: a null text counts as empty; rows without doc_id come after all others; rows with equal doc_id
don't clean each other; texts below `length` bytes keep all; repeats inside a document stay; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import mix64, texts

LENGTH = 50
ANCHOR = 16
#: Text bytes of a chunk and, on average, of a bucket.
CHUNK_BYTES, BUCKET_BYTES = 4_000_000, 2_000_000
#: Segment bytes of one index inside a bucket.
INDEX_BYTES = 120_000
_LAST = np.iinfo(np.int64).max
#: Windows looked at together: their hashes stay in the processor's cache.
_BLOCK = 16_384


def anchors(buffer: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, hash) of each run of windows with one anchor; windows stay inside documents."""
    n = len(buffer)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    wide, total = length - ANCHOR + 1, n - length + 1
    c1, c2, c3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
    low = np.uint64(0xFFFF)
    place = np.arange(_BLOCK + wide, dtype=np.uint64)
    cuts, where, hashes = [], [], []
    for s in range(0, total, _BLOCK):
        count = min(_BLOCK, total - s)
        grams = count + wide - 1
        words = np.ndarray(grams + 8, "<u8", buffer, s, (1,)).copy()
        tail = words[8:]
        h = tail >> np.uint64(31)
        h ^= tail
        h *= c2
        words = words[:grams]
        words *= c1
        h ^= words
        np.right_shift(h, np.uint64(29), out=words)
        h ^= words
        h *= c3
        np.right_shift(h, np.uint64(32), out=words)
        h ^= words
        least = (h & ~low) | place[:grams]
        span = 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (least[first] & low).astype(np.int64)
        cuts.append(first + s)
        where.append(at + s)
        hashes.append(h[at])
    # runs also start where a document starts, and end with its last window
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= length
    begin, stop = starts[long], ends[long] - length + 1
    cut, at, hashed = np.concatenate(cuts), np.concatenate(where), np.concatenate(hashes)
    edges = np.sort(np.concatenate([cut, begin, stop[stop < total]]), kind="stable")
    edges = edges[np.concatenate([[True], edges[1:] != edges[:-1]])]
    of = np.searchsorted(cut, edges, "right") - 1
    last = np.concatenate([edges[1:], [total]]) - 1
    inside = np.searchsorted(begin, edges, "right") - 1
    keep = (inside >= 0) & (edges < stop[np.maximum(inside, 0)]) if len(begin) else np.zeros(len(edges), bool)
    first, last, of = edges[keep], last[keep], of[keep]
    at, hashed = at[of], hashed[of]
    # blocks cut runs: join neighbours with one anchor in one document
    doc = np.searchsorted(ends, first, "right")
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) if len(first) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    stop = np.concatenate([begin[1:], [len(first)]])[: len(begin)] - 1
    return doc[begin], first[begin], last[stop], hashed[begin]


class Chunk:
    """The documents of one chunk in a fixed order, with their anchors."""

    def __init__(self, rows: pa.Table, length: int):
        ids = rows.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        raw = texts(rows.column("text").combine_chunks())
        order = sorted(range(len(raw)), key=lambda k: (ids[k], raw[k]))
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.known = [rows.column("doc_id")[k].as_py() for k in order]
        self.raw = [raw[k] for k in order]
        self.ends = np.cumsum([len(x) for x in self.raw])
        self.buffer = b"".join(self.raw)
        self.doc, self.first, self.last, self.hash = anchors(self.buffer, self.ends, length)
        self.length = length

    def segments(self, shared: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct segments around shared anchors: (bytes, hash, smallest id, largest id); and (run, segment) of each run used."""
        shared = np.sort(shared)
        found = np.searchsorted(shared, self.hash)
        found[found == len(shared)] = 0
        runs = np.flatnonzero(shared[found] == self.hash) if len(shared) else np.empty(0, np.int64)
        buffer, extra = self.buffer, self.length
        parts = [buffer[a : b + extra] for a, b in zip(self.first[runs].tolist(), self.last[runs].tolist(), strict=True)]
        # only segments with a common anchor can be equal
        _, same, times = np.unique(self.hash[runs], return_inverse=True, return_counts=True)
        of = np.arange(len(parts))
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(times[same] > 1).tolist():
            of[k] = seen.setdefault(parts[k], k)
        kept, of = np.unique(of, return_inverse=True)
        index = [parts[k] for k in kept.tolist()]
        least = np.full(len(index), _LAST)
        most = np.full(len(index), -_LAST)
        np.minimum.at(least, of, self.ids[self.doc[runs]])
        np.maximum.at(most, of, self.ids[self.doc[runs]])
        hashes = np.zeros(len(index), np.uint64)
        hashes[of] = self.hash[runs]
        return index, hashes, least, most, np.stack([runs, of], 1) if len(runs) else np.empty((0, 2), np.int64)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _split(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, cuts) if len(part)]


class RunIndex:
    """Run-length Burrows-Wheeler transform of texts joined by a zero byte, with sampled run ends.

    Texts are distinct and of at most `longest` bytes, so suffixes differ within 2 * longest + 2 bytes.
    """

    def __init__(self, parts: list[bytes], longest: int):
        joined = b"\0" + b"\0".join(parts) + b"\0"
        self.text = np.frombuffer(joined, np.uint8)
        self.starts = np.cumsum([1] + [len(p) + 1 for p in parts])[:-1]
        n = self.n = len(joined)
        order, rank = self._suffixes(joined, 2 * longest + 2)
        before = self.text[order - 1]  # the first suffix is preceded by the last byte: the text is read as a ring
        edge = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_from = np.concatenate([[0], edge])
        run_to = np.concatenate([edge, [n]])
        char = before[self.run_from].astype(np.int64)
        sizes = run_to - self.run_from
        by_char = np.argsort(char, kind="stable")
        seen = np.cumsum(sizes[by_char])
        self.key = char[by_char] * (n + 1) + self.run_from[by_char]
        # rows that start with a byte follow those of smaller bytes: runs in order of byte fill them in turn
        self.lf = seen - sizes[by_char]
        self.from_, self.to = self.run_from[by_char], run_to[by_char]
        self.sample_from, self.sample_to = order[self.from_], order[self.to - 1]
        self.char = char[by_char]
        self.order = order

    def _suffixes(self, joined: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(joined)
        ring = joined + (joined * (depth // n + 1))[: depth + 64]
        words = np.empty(n, np.uint64)
        for j in range(8):
            lane = words[j::8]
            lane[:] = np.frombuffer(ring, ">u8", len(lane), j)
        order = np.argsort(words, kind="stable")
        rank = self._ranks(order, words[order])
        self.rank8 = rank
        span = 8
        while span < depth:
            # only suffixes that still share their rank are sorted further
            again = rank[order]
            tied = np.zeros(n, bool)
            same = again[1:] == again[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            rows = np.flatnonzero(tied)
            if not len(rows):
                if span == 8:
                    self.rank16 = rank
                if span <= 16:
                    self.rank32 = rank
                break
            part = order[rows]
            key = rank[part] * n + rank[(part + span) % n]
            by = np.argsort(key, kind="stable")
            part, key = part[by], key[by]
            order[rows] = part
            fresh = rank.copy()
            new = np.concatenate([[True], key[1:] != key[:-1]])
            fresh[part] = rows[np.flatnonzero(new)][np.cumsum(new) - 1]
            rank = fresh
            span *= 2
            if span == 16:
                self.rank16 = rank
            if span == 32:
                self.rank32 = rank
        if not hasattr(self, "rank16"):
            self.rank16 = rank
        if not hasattr(self, "rank32"):
            self.rank32 = rank
        return order, rank

    @staticmethod
    def _ranks(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        return rank

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, up to most (at most 64)."""
        n, size = self.n, np.zeros(len(a), np.int64)
        for rank, span in ((self.rank32, 32), (self.rank32, 32), (self.rank16, 16), (self.rank8, 8)):
            size += span * (rank[(a + size) % n] == rank[(b + size) % n])
        going = np.ones(len(a), bool)
        for _ in range(7):
            going &= self.text[(a + size) % n] == self.text[(b + size) % n]
            if not going.any():
                break
            size += going
        return np.minimum(size, most)

    def least_by_window(self, owner_least: np.ndarray, length: int) -> np.ndarray:
        """By text position: the smallest id among texts that hold the `length` bytes from there."""
        text_of = np.searchsorted(self.starts, np.arange(self.n), "right") - 1
        ids = owner_least[np.maximum(text_of, 0)]
        ends = np.concatenate([self.starts[1:] - 1, [self.n - 1]])
        whole = (text_of >= 0) & (np.arange(self.n) + length <= ends[np.maximum(text_of, 0)])
        ids = np.where(whole, ids, _LAST)
        order = self.order
        second = length - 32
        same = (self.rank32[order[1:]] == self.rank32[order[:-1]]) & (self.rank32[(order[1:] + second) % self.n] == self.rank32[(order[:-1] + second) % self.n])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(ids[order], first)
        out = np.empty(self.n, np.int64)
        out[order] = np.repeat(least, np.diff(np.concatenate([first, [self.n]])))
        return out

    def stream(self, parts: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of parts, right to left in step: (length up to cap, text position) by byte of the joined parts."""
        sizes = np.array([len(p) for p in parts])
        flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        stops = np.cumsum(sizes)
        length, place = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        row, at, got = (np.zeros(len(parts), np.int64) for _ in range(3))
        at[:] = self.order[0]
        for step in range(int(sizes.max(initial=0))):
            live = by_size[: np.searchsorted(-sizes[by_size], -step, "left")]
            here = stops[live] - 1 - step
            c, q, s, m = flat[here], row[live], at[live], got[live]
            j = np.searchsorted(self.key, c * (self.n + 1) + q, "right") - 1
            ahead = (j >= 0) & (self.char[np.maximum(j, 0)] == c)
            hit = ahead & (q < self.to[np.maximum(j, 0)])
            off = np.flatnonzero(~hit)
            if len(off):
                jo = j[off]
                up = ahead[off]
                down = jo + 1 < len(self.key)
                down &= self.char[np.minimum(jo + 1, len(self.key) - 1)] == c[off]
                ju, jd = np.maximum(jo, 0), np.minimum(jo + 1, len(self.key) - 1)
                su, sd = self.sample_to[ju], self.sample_from[jd]
                lu = np.where(up, self.common(s[off], su, cap), -1)
                ld = np.where(down, self.common(s[off], sd, cap), -1)
                above = lu >= ld
                q[off] = np.where(above, self.to[ju] - 1, self.from_[jd])
                s[off] = np.where(above, su, sd)
                j[off] = np.where(above, ju, jd)
                best = np.maximum(lu, ld)
                m[off] = np.where(best >= 0, np.minimum(m[off], best), -1)
            lost = m < 0
            q = self.lf[j] + q - self.from_[j]
            s = (s - 1) % self.n
            m = np.minimum(m + 1, cap)
            if lost.any():  # the byte is not in the index
                q[lost], s[lost], m[lost] = 0, self.order[0], 0
            row[live], at[live], got[live] = q, s, m
            length[here], place[here] = m, s
        return length, place


def _windows(parts: list[bytes], least: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(part, first, stop, id): runs of windows whose smallest id is below the largest id of their part."""
    built = RunIndex(parts, max(map(len, parts)))
    floor = built.least_by_window(least, length)
    size, place = built.stream(parts, length)
    stops = np.cumsum([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), np.diff(np.concatenate([[0], stops])))
    low = np.where(size >= length, floor[place], _LAST)
    use = low < most[owner]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (low[1:] != low[:-1]) | (use[1:] != use[:-1])])
    begin = np.flatnonzero(new)
    stop = np.concatenate([begin[1:], [len(low)]])
    keep = use[begin]
    begin, stop = begin[keep], stop[keep]
    whose, base = owner[begin], np.concatenate([[0], stops[:-1]])
    return whose, begin - base[whose], stop - base[whose], low[begin]


def _packed(number: np.ndarray, parts: list[bytes], sub: np.ndarray, least: np.ndarray, most: np.ndarray) -> bytes:
    """The segments of a chunk for one bucket, compressed: they are what is shuffled most."""
    import zstandard

    sizes = np.array([len(p) for p in parts], "<i4")
    head = np.array([len(parts)], "<i4")
    fields = [head, number.astype("<i4"), sizes, sub, least.astype("<i8"), most.astype("<i8")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([f.tobytes() for f in fields] + parts))


def _unpacked(raw: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    at, out = 4, []
    for kind in ("<i4", "<i4", "u1", "<i8", "<i8"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    cuts = (at + np.cumsum(out[1])).tolist()
    return out[0], [raw[a:b] for a, b in zip([at, *cuts[:-1]], cuts, strict=True)], out[2], out[3], out[4]


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def dedup_substrings(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans and the kept bytes.

    `length` is 33 to 64. Removing bytes can split characters, so the kept text is binary.
    """
    if not 33 <= length <= 64:
        raise ValueError("length must be 33 to 64")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(12, -(-total // CHUNK_BYTES)), max(12, -(-total // BUCKET_BYTES))
    text = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(chunks)).alias("chunk"))

    def send_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows, length)
        once, where = np.unique(chunk.hash, return_inverse=True)
        low, high = np.full(len(once), _LAST), np.full(len(once), -1)
        np.minimum.at(low, where, chunk.doc)
        np.maximum.at(high, where, chunk.doc)
        twice = (high > low).astype(np.uint8)
        parts = _split(_bucket_of(once, buckets))
        return _table({
            "bucket": ([b for b, _ in parts], pa.int64()), "chunk": ([key[0].as_py()] * len(parts), pa.int64()),
            "hashes": ([once[p].tobytes() for _, p in parts], pa.binary()), "twice": ([twice[p].tobytes() for _, p in parts], pa.binary()),
        })

    def shared_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        every = np.concatenate(lists)
        twice = np.frombuffer(b"".join(rows.column("twice").to_pylist()), np.uint8) > 0
        u, where, n = np.unique(every, return_inverse=True, return_counts=True)
        shared = n > 1
        shared[where[twice]] = True
        marks = np.split(shared[where], np.cumsum([len(x) for x in lists])[:-1])
        out = [(c, x[k].tobytes()) for c, x, k in zip(rows.column("chunk").to_pylist(), lists, marks, strict=True) if k.any()]
        return _table({"chunk": ([c for c, _ in out], pa.int64()), "shared": ([x for _, x in out], pa.binary())})

    def send_segments(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        chunk = Chunk(rows, length) if rows.num_rows and marks.num_rows else None
        found = chunk.segments(np.frombuffer(b"".join(marks.column("shared").to_pylist()), np.uint64)) if chunk else ([], np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        parts, hashes, least, most, _ = found
        split = _split(_bucket_of(hashes, buckets)) if parts else []
        sub = (mix64(hashes) >> np.uint64(56)).astype(np.uint8)
        return _table({
            "bucket": ([b for b, _ in split], pa.int64()), "chunk": ([key[0].as_py()] * len(split), pa.int64()),
            "segments": ([_packed(p, [parts[k] for k in p], sub[p], least[p], most[p]) for _, p in split], pa.binary()),
        })

    def match(key: tuple, rows: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        got = [_unpacked(x) for x in rows.column("segments").to_pylist()]
        of = [np.array([index.setdefault(p, len(index)) for p in parts], np.int64) for _, parts, _, _, _ in got]
        lists = [number for number, _, _, _, _ in got]
        parts, every = list(index), np.concatenate(of)
        least, most, sub = np.full(len(parts), _LAST), np.full(len(parts), -_LAST), np.zeros(len(parts), np.int64)
        np.minimum.at(least, every, np.concatenate([x[3] for x in got]))
        np.maximum.at(most, every, np.concatenate([x[4] for x in got]))
        sub[every] = np.concatenate([x[2] for x in got])
        # equal windows have equal anchors, so indexes of a few anchors each are exact, and stay in the processor's cache
        groups = min(256, -(-sum(map(len, parts)) // INDEX_BYTES))
        mine = [g for _, g in _split(sub % groups)]
        found = [_windows([parts[k] for k in g], least[g], most[g], length) for g in mine]
        whose = np.concatenate([g[f[0]] for g, f in zip(mine, found, strict=True)])
        from_, to, ids_ = (np.concatenate([f[c] for f in found]) for c in (1, 2, 3))
        order = np.argsort(whose, kind="stable")
        whose, from_, to, ids_ = whose[order], from_[order], to[order], ids_[order]
        first = np.searchsorted(whose, np.arange(len(parts) + 1))
        out = []
        for c, o, number in zip(rows.column("chunk").to_pylist(), of, lists, strict=True):
            n = first[o + 1] - first[o]
            pick = np.repeat(first[o] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            if len(pick):
                out.append((c, np.repeat(number, n).astype(np.int32).tobytes(), from_[pick].astype(np.int32).tobytes(), to[pick].astype(np.int32).tobytes(), ids_[pick].tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return _table({k: (list(v), pa.int64() if k == "chunk" else pa.binary()) for k, v in zip(("chunk", "segment", "first", "stop", "low"), cols, strict=True)})

    def clean(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _out([])
        chunk = Chunk(rows, length)
        gone = np.zeros(len(chunk.buffer) + 1, np.int64)
        held = [x for x in marks.column("shared").to_pylist() if x]
        if held:
            _, _, _, _, runs = chunk.segments(np.frombuffer(b"".join(held), np.uint64))
            get = lambda name, kind: np.frombuffer(b"".join(x for x in marks.column(name).to_pylist() if x), kind)
            seg, a, b, low = get("segment", np.int32), get("first", np.int32), get("stop", np.int32), get("low", np.int64)
            order = np.argsort(seg, kind="stable")
            seg, a, b, low = seg[order], a[order], b[order], low[order]
            lo, n = np.searchsorted(seg, runs[:, 1]), np.searchsorted(seg, runs[:, 1], "right") - np.searchsorted(seg, runs[:, 1])
            pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            run = np.repeat(runs[:, 0], n)
            true = low[pick] < chunk.ids[chunk.doc[run]]
            pick, run = pick[true], run[true]
            np.add.at(gone, chunk.first[run] + a[pick], 1)
            np.add.at(gone, chunk.first[run] + b[pick] + length - 1, -1)
        dead = np.cumsum(gone[:-1]) > 0
        out, start = [], 0
        for doc, raw in zip(chunk.known, chunk.raw, strict=True):
            part = dead[start : start + len(raw)]
            start += len(raw)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]])))
            spans = edges.reshape(-1, 2)
            kept = raw if not len(spans) else np.frombuffer(raw, np.uint8)[~part].tobytes()
            out.append((doc, len(raw), int(part.sum()), len(spans), hashlib.sha256(kept).hexdigest(), *(([{"start": int(x), "stop": int(y)} for x, y in spans], kept) if with_text else ())))
        return _out(out)

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] + [span, pa.binary()] * with_text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(kinds)]

    def _out(rows: list[tuple]) -> pa.Table:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names, cols, kinds, strict=True)})

    grouped = text.groupBy("chunk")
    shared = grouped.applyInArrow(send_anchors, "bucket long, chunk long, hashes binary, twice binary").groupBy("bucket").applyInArrow(shared_anchors, "chunk long, shared binary")
    segments = grouped.cogroup(shared.groupBy("chunk")).applyInArrow(send_segments, "bucket long, chunk long, segments binary")
    matches = segments.groupBy("bucket").applyInArrow(match, "chunk long, segment binary, first binary, stop binary, low binary")
    marks = shared.select("chunk", "shared", *[F.lit(None).cast("binary").alias(c) for c in ("segment", "first", "stop", "low")]).unionAll(
        matches.select("chunk", F.lit(None).cast("binary").alias("shared"), "segment", "first", "stop", "low")
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,stop:long>>, kept binary" * with_text
    return grouped.cogroup(marks.groupBy("chunk")).applyInArrow(clean, schema)
