"""Ranked search: the best documents of each item by a lexical score in whole numbers.

Items are taken in ranges of item_id whose terms fit a stated bound, so that what is broadcast never grows
with the table. Documents are split over tasks; each scores its own documents by sorting, and keeps the
best of each item on a heap.

Cases: null texts and texts without a term match nothing and don't count as documents; rows of one item_id
(null included) are one item with all their terms; repeated documents are found once each; equal scores go
by doc_id, null last; long texts are read slice by slice; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import persist, texts

#: Pairs of term and item that one range holds, about: some 100 bytes each in a task.
RANGE_PAIRS = 500_000
#: Impacts that are sorted at one time.
SORTED = 1 << 21
#: Bytes of a text that are split into terms at one time.
SLICE = 1 << 20

#: Fixed by the contract: letters, digits and everything beyond ASCII make terms; only A to Z change.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a slice at a time."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = len(text) if len(text) - at <= SLICE else text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (item_id, term), each pair once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch.column("text")), strict=True):
                for part in terms(text):
                    found = list(set(part))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(split, "item_id long, term string").distinct()


def ranges(pairs: DataFrame, range_pairs: int = RANGE_PAIRS) -> list[DataFrame]:
    """The pairs in ranges of item_id of about so many pairs; no item is in two, null ids are in the first."""
    parts = max(1, -(-pairs.count() // range_pairs))
    cuts = []
    if parts > 1:
        at = F.percentile_approx("item_id", [k / parts for k in range(1, parts)], 100 * parts)
        cuts = sorted(set(pairs.select(at.alias("at")).first()["at"] or []))
    item, out = F.col("item_id"), []
    for low, high in itertools.pairwise([None, *cuts, None]):
        inside = (item > low if low is not None else F.lit(True)) & (item <= high if high is not None else F.lit(True))
        out.append(pairs.where(inside | item.isNull() if low is None else inside))
    return out


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """For each document with a term: its number of terms, and the numbered terms it holds with their counts.

    Rows: doc_id, n, terms array<int>, counts array<int>.
    """
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, texts(batch.column("text")), strict=True):
                n, found = 0, []
                for part in terms(text):
                    n += len(part)
                    mine = np.fromiter(map(number.get, part, itertools.repeat(-1)), np.int32, len(part))
                    found.append(np.unique(mine[mine >= 0], return_counts=True))
                if n:
                    term, by_slice = (np.concatenate(x) for x in zip(*found, strict=True))
                    if len(found) > 1:
                        term, inverse = np.unique(term, return_inverse=True)
                        by_slice = np.bincount(inverse, by_slice, len(term)) if len(term) else by_slice
                    rows.append((doc, n, term, by_slice.astype(np.int32)))
            if rows:
                doc, n, term, counts = zip(*rows, strict=True)
                ends = pa.array(np.cumsum([0, *map(len, term)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in (term, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>")


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys up to `most`: 16 bits at a time, which numpy sorts by radix."""
    order, shift = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable"), 16
    while most >> shift:
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def accumulate(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, starts: np.ndarray, items: np.ndarray, n_items: int, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of pairs (item, doc): the items of each posting side by side, sorted by pair, summed in runs."""
    fan = starts[term + 1] - starts[term]
    total = int(fan.sum())
    if not total:
        return (np.empty(0, np.int64),) * 3
    which = np.repeat(np.arange(len(term)), fan)
    inside = np.arange(total) - np.repeat(np.cumsum(fan) - fan, fan)
    key = items[starts[term[which]] + inside] * n_docs + doc[which]
    order = radix_order(key, n_items * n_docs)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] // n_docs, key[first] % n_docs, np.add.reduceat(impact[which][order], first)


def best(found: DataFrame, index: tuple, documents: int, all_terms: int, top: int) -> DataFrame:
    """The best documents of each item among those of one task: rows (item_id, doc_id, score).

    index: weight of each term, where its items start, the items, and the item ids.
    """
    held = found.sparkSession.sparkContext.broadcast(index)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, starts, items, ids = held.value
        heaps: list[list] = [[] for _ in ids]
        least = np.zeros(len(ids), np.int64)
        fans = starts[1:] - starts[:-1]
        for batch in batches:
            docs, n = batch.column("doc_id").to_pylist(), batch.column("n").to_numpy()
            ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
            term, count = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            ends = ends - ends[0]
            length = 10 + (90 * n * documents) // all_terms
            doc = np.repeat(np.arange(len(docs)), np.diff(ends))
            impact = weight[term] * ((1_000_000_000 * count.astype(np.int64)) // (1000 * count.astype(np.int64) + 8 * length[doc]))
            made = np.concatenate(([0], np.cumsum(fans[term])))
            low = 0
            while low < len(docs):  # whole documents, about SORTED impacts at a time
                high = max(low + 1, int(np.searchsorted(made[ends], made[ends[low]] + SORTED, "right")) - 1)
                part = slice(ends[low], ends[high])
                item, at, total = accumulate(term[part], doc[part] - low, impact[part], starts, items, len(ids), high - low)
                good = (total > 0) & (total >= least[item])
                for i, d, s in zip(item[good].tolist(), at[good].tolist(), total[good].tolist(), strict=True):
                    name, heap = docs[low + d], heaps[i]
                    entry = (s, name is not None, -(name or 0))
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        least[i] = heap[0][0]
                low = high
        rows = [(ids[i], -d if known else None, s) for i, heap in enumerate(heaps) for s, known, d in heap]
        for s in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[s : s + 20_000], strict=True)], ["item_id", "doc_id", "score"])

    return found.mapInArrow(score, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """The `top` highest-scoring documents of each item: rows (item_id, rank, doc_id, score)."""
    pairs = persist(item_terms(items), "search-terms")
    parts = [_search_range(docs, part, top) for part in ranges(pairs, range_pairs)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _search_range(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """One range of items against all documents; what tasks found is written before the next range."""
    words = [r["term"].encode() for r in pairs.select("term").distinct().orderBy("term").toLocalIterator()]
    numbers = {w: k for k, w in enumerate(words)}
    found = persist(postings(docs, numbers), "search-postings")
    size = found.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    if not size["n"] or not words:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
    df = np.zeros(len(words), np.int64)
    df[held["term"]] = held["df"]
    weight = np.floor(1000 * np.log((2 * size["n"] + 2) / (2 * df + 1))).astype(np.int64)
    weight[df == 0] = 0
    ids, at = [], {}
    by_term = np.empty((pairs.count(), 2), np.int64)
    for k, r in enumerate(pairs.toLocalIterator()):
        item = at.setdefault(r["item_id"], len(at))
        if item == len(ids):
            ids.append(r["item_id"])
        by_term[k] = numbers[r["term"].encode()], item
    by_term = by_term[np.lexsort((by_term[:, 1], by_term[:, 0]))]
    starts = np.searchsorted(by_term[:, 0], np.arange(len(words) + 1))
    return persist(best(found, (weight, starts, by_term[:, 1].copy(), ids), size["n"], size["terms"], top), "search-hits")
