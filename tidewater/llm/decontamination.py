"""Benchmark decontamination: BM25 with block-max bounds over an inverted index of test items.

Every passage of every document is a query against the index of test items. Scores are relative to an
item's score against itself, so one threshold serves long and short items. The bounds of block-max WAND are taken
for slices of passages instead of one cursor at a time: the maxima of a passage's terms in a block of items say what
the items of that block can reach, first without the commonest terms; only postings in blocks that can reach the
threshold are read, and scored in full. Hits are verified by the overlap of question and answer word triples.
Maxima are kept only for blocks in which a term occurs, so an index grows with its postings.

Cases: a null or empty text has no passages; items without words or with a null id are not indexed;
items with equal texts are all reported; repeated document rows give equal hits; a null doc_id is
reported as null; very long texts are read in slices of passages; an empty table gives no rows; other
columns are kept by `drop_contaminated` and ignored elsewhere.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import texts

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to be verified.
THRESHOLD = 0.4
#: Shares of the question's and the answer's word triples that a contaminated passage holds at least.
QUESTION, ANSWER = 0.6, 0.6
BLOCK_ITEMS = 4
LEAST_WINDOW = 64
#: Windows of a document whose bounds are taken at one time, so that memory doesn't grow with its length.
SLICE_WINDOWS = 128
#: Most items of one index that travels to executors: its size follows their words (about 40 bytes each, 30 MB at 30 words); more items
#: make more indexes, each a pass.
INDEX_ITEMS = 20_000

_WORD = re.compile(r"\w+")
#: Share of the threshold that the commonest terms may make up together; they alone never make a passage live.
COMMON = 0.1


def words(raw: bytes) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(raw.decode("utf-8", "replace").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: the answer is the last sentence or line, or else the last third of the words."""
    parts = [w for w in (words(p.encode()) for p in re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    if len(parts) > 1 and len(parts[-1]) >= 3:
        return [w for p in parts[:-1] for w in p], parts[-1]
    every = [w for p in parts for w in p]
    cut = max(1, len(every) - max(1, len(every) // 3))
    return every[:cut], every[cut:]


def triples(ws: list[str]) -> set[tuple]:
    return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


@dataclass
class Index:
    """Postings by term in order of item; impacts are shares of the item's own score."""

    ids: np.ndarray
    terms: dict[str, int]
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    most: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray
    entry_starts: np.ndarray
    window: int
    parts: list[tuple[set, set]]
    edge: float
    common: float


def build(items: list[tuple[int, str]]) -> Index | None:
    split = [(i, t, ws) for i, t in sorted(items) if (ws := words(t.encode()))]
    if not split:
        return None
    split.sort(key=lambda x: (len(x[2]), x[0]))  # items of like length share blocks: tighter bounds
    n, mean = len(split), sum(len(ws) for _, _, ws in split) / len(split)
    postings: dict[str, list[tuple[int, float]]] = {}
    for k, (_, _, ws) in enumerate(split):
        for w in set(ws):
            postings.setdefault(w, []).append((k, float(ws.count(w))))
    terms = {w: j for j, w in enumerate(sorted(postings))}
    own = np.zeros(n)
    starts, items_, impacts = [0], [], []
    for w in terms:
        rows = postings[w]
        idf = math.log(1 + (n - len(rows) + 0.5) / (len(rows) + 0.5))
        for k, tf in rows:
            size = len(split[k][2])
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            own[k] += impact
            items_.append(k)
            impacts.append(impact)
        starts.append(len(items_))
    at = np.array(items_, np.int32)
    share = np.array(impacts) / own[at]
    first = np.array(starts)
    # postings of a term are in order of item, so each run of one term and block is a block of its own
    of = np.repeat(np.arange(len(terms)), np.diff(first))
    runs = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] // BLOCK_ITEMS != at[:-1] // BLOCK_ITEMS)]))
    block_most = np.maximum.reduceat(np.nextafter(share.astype(np.float32), np.float32(2)), runs)
    block_starts = np.searchsorted(of[runs], np.arange(len(terms) + 1))
    window = max(LEAST_WINDOW, 2 * max(len(ws) for _, _, ws in split))
    parts = [tuple(map(triples, question_answer(t))) for _, t, _ in split]
    # the commonest terms: those of least maxima that add up to a share of the threshold
    most = np.maximum.reduceat(block_most, block_starts[:-1]).astype(np.float64)
    rising = np.sort(most)
    n = int(np.searchsorted(np.cumsum(rising), COMMON * THRESHOLD))
    edge = float(rising[n - 1]) if n else -1.0
    common = float(most[most <= edge].sum())
    if common >= THRESHOLD:  # ties at the edge
        edge, common = -1.0, 0.0
    return Index(np.array([i for i, _, _ in split]), terms, first, at, share, most, block_starts, at[runs] // BLOCK_ITEMS, block_most, np.append(runs, len(at)), window, parts, edge, common)


def _ranges(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of all entries of some terms, of which term t has those from starts[t] to starts[t + 1]."""
    sizes = starts[terms + 1] - starts[terms]
    return np.repeat(starts[terms] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _postings(index: Index, entries: np.ndarray) -> np.ndarray:
    """Places of the postings of some entries (the postings of one term in one block)."""
    return _ranges(index.entry_starts, entries)


def _sums(cell: np.ndarray, value: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur and their sums; values of a cell are added in the order given."""
    if cells <= 4 * len(cell) + 100_000:
        sums = np.bincount(cell, value, cells)
        at = np.flatnonzero(np.bincount(cell, minlength=cells))
        return at, sums[at]
    at, where = np.unique(cell, return_inverse=True)
    return at, np.bincount(where, value, len(at))


def _slice_hits(index: Index, ids: np.ndarray, windows: int, step: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) at threshold or above, for windows that begin every `step` words and are twice as long.

    The block maxima of a window's terms bound what the items of each block can reach: first without the commonest
    terms, which can't add more than their maxima together, then with them. Postings are read in blocks that pass both.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at = np.flatnonzero(ids >= 0)
    # a word lies in the window that starts at or before its step, and in the one before
    own = at // step
    window = np.concatenate([own, own - 1])
    keys = (window * len(index.most) + np.concatenate([ids[at], ids[at]]))[(window >= 0) & (window < windows)]
    if not len(keys):
        return none
    keys.sort()
    window, term = np.divmod(keys[np.concatenate([[True], keys[1:] != keys[:-1]])], len(index.most))
    blocks, n = -(-len(index.ids) // BLOCK_ITEMS), len(index.ids)

    def entries(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some of the terms, and the cell (window and block) of each."""
        found = _ranges(index.block_starts, term[use])
        sizes = index.block_starts[term[use] + 1] - index.block_starts[term[use]]
        return found, np.repeat(window[use], sizes) * blocks + index.blocks[found]

    found, cell = entries(index.most[term] > index.edge)
    reached, bound = _sums(cell, index.block_most[found], windows * blocks)
    reached = reached[bound >= (threshold - index.common) * (1 - 1e-6)]
    if not len(reached):
        return none
    live = np.zeros(windows * blocks, bool)
    live[reached] = True
    of_live = np.zeros(windows, bool)
    of_live[reached // blocks] = True
    found, cell = entries(of_live[window])
    found, cell = found[live[cell]], cell[live[cell]]
    reached, bound = _sums(cell, index.block_most[found], windows * blocks)
    live[reached[bound < threshold * (1 - 1e-6)]] = False
    found, cell = found[live[cell]], cell[live[cell]]
    if not len(found):
        return none
    post = _postings(index, found)
    pair = np.repeat(cell // blocks, index.entry_starts[found + 1] - index.entry_starts[found]) * n + index.items[post]
    pair, score = _sums(pair, index.impacts[post], windows * n)
    hit = score >= threshold
    return pair[hit] // n, pair[hit] % n, score[hit]


def search(index: Index, ids: np.ndarray, threshold: float) -> Iterator[tuple[int, list[tuple[int, float]]]]:
    """(start, [(item, score)]) of the windows of a document that have items at threshold or above.

    ids: the document's words as term numbers, -1 for words outside the index.
    """
    step = index.window // 2
    starts = np.arange(0, max(1, len(ids) - step), step)
    for k in range(0, len(starts), SLICE_WINDOWS):
        some = starts[k : k + SLICE_WINDOWS]
        held: dict[int, list] = {}
        for w, item, score in zip(*(x.tolist() for x in _slice_hits(index, ids[some[0] : some[-1] + index.window], len(some), step, threshold)), strict=True):
            held.setdefault(w, []).append((item, score))
        yield from ((int(some[w]), found) for w, found in held.items())


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start int"


def _hits(index: Index, raw: bytes, threshold: float) -> dict[int, tuple]:
    """item -> its best verified passage (score, question overlap, answer overlap, start)."""
    ws = words(raw)
    best: dict[int, tuple] = {}
    ids = np.fromiter(map(index.terms.get, ws, repeat(-1)), np.int64, len(ws))
    for start, found in search(index, ids, threshold):
        held = triples(ws[start : start + index.window])
        for k, score in found:
            q, a = index.parts[k]
            ours = (len(q & held) / len(q) if q else 1.0, len(a & held) / len(a) if a else 1.0)
            if ours[0] >= QUESTION and ours[1] >= ANSWER:
                best[k] = max(best.get(k, (-1.0,)), (round(score, 6), round(ours[0], 6), round(ours[1], 6), -start))
    return best


def indexes(benchmark: DataFrame, most: int = INDEX_ITEMS) -> list[Index]:
    """Indexes of at most `most` items each, built one after another from a count-checked part of the items."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").dropDuplicates()
    parts = max(1, -(-items.count() // most))
    made = []
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).limit(2 * most + 1000).collect()
        if len(rows) > 2 * most:
            raise ValueError(f"part {p} of the test items is larger than {2 * most}; raise `most`")
        if (index := build([(x[0], x[1]) for x in rows])) is not None:
            made.append(index)
    return made


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = INDEX_ITEMS) -> DataFrame:
    """Verified hits: (doc_id, item_id, score, question_overlap, answer_overlap, passage_start), best passage each."""
    spark = docs.sparkSession
    found = None
    for index in indexes(benchmark, most):
        shared = spark.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(**shared.value)
            for batch in batches:
                rows = [(doc, int(index.ids[k]), s, q, a, -at) for doc, raw in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True) for k, (s, q, a, at) in sorted(_hits(index, raw, threshold).items())]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in HITS.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(run, HITS)
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], HITS) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = INDEX_ITEMS) -> DataFrame:
    """The documents without a verified hit, with all their columns."""
    for index in indexes(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(**shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not _hits(index, raw, threshold) for raw in texts(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
