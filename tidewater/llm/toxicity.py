"""Toxicity by cumulative-link ordinal regression on sparse word features.

One weight vector serves all ordered thresholds: P(grade >= k) = sigmoid(w . x - t_k). Grades are 0
(clean), 1 and 2; among labelled toxic rows, those with more distinct toxic-associated words than the
sample's median are grade 2. The model is fitted on the driver from at most SAMPLE_ROWS labelled
rows, taken by hash of doc_id; every document is scored.

Cases: a null or empty text has no features and gets the severity of none; a null doc_id is scored; labels that are
null or without a document are not used; without both kinds of label nothing is toxic; repeated rows
get equal scores; very long texts count each word once; an empty table gives no rows; other columns
are kept by `drop_toxic` and ignored by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Memo, mix64, texts

#: Most labelled rows that the driver fits on (features only, a few MB).
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 20
GRADES = 3
#: A word takes part if its rate among toxic rows stands out by so many standard errors, in so many rows
#: and in such a share of them: words of a few copied documents don't.
STANDS_OUT, LEAST_ROWS, LEAST_SHARE = 5.0, 5, 0.0004
STEPS, RATE, SHRINK = 300, 0.03, 1e-3
#: Starting weight of a telling word (less for words seen in few rows) and first threshold.
FULL_WEIGHT, FULL_ROWS, FIRST_CUT = 6.0, 10, 3.0
TOXIC_AT = 0.5

_FOLD = bytes(32 if 33 <= i <= 47 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 126 else i for i in range(256))


def words(raw: bytes) -> list[bytes]:
    """Lower-case words, ASCII punctuation as a break."""
    return raw.decode("utf-8", "replace").lower().encode().translate(_FOLD).split()


def _bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 1) & (BUCKETS - 1)


@dataclass
class Ordinal:
    """Weights shared by all thresholds; buckets that carry no weight are zero."""

    weights: np.ndarray
    cuts: np.ndarray

    def levels(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(-(eta[:, None] - self.cuts[None, :])))


def unlike(rows: list[np.ndarray], bands: int = 10, per_band: int = 8) -> list[int]:
    """Indexes of rows without near copies before them: copied documents would make their words look telling.

    Rows that share a band of min-hashes count as copies.
    """
    sizes = np.array([len(r) for r in rows])
    full = np.flatnonzero(sizes)
    if not len(full):
        return list(range(len(rows)))
    flat = np.concatenate([rows[k] for k in full]).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    seen: set[tuple[int, int]] = set()
    mine: list[list[tuple[int, int]]] = [[] for _ in rows]
    for band in range(bands):
        joined = np.zeros(len(full), np.uint64)
        for k in range(per_band):
            salt = np.uint64(0x9E3779B97F4A7C15 * (band * per_band + k + 1) % 2**64)
            joined = mix64(joined ^ np.minimum.reduceat(mix64(flat ^ salt), starts))
        for row, value in zip(full.tolist(), joined.tolist(), strict=True):
            mine[row].append((band, value))
    kept = []
    for row, bands_ in enumerate(mine):
        if not seen.intersection(bands_):
            kept.append(row)
            seen.update(bands_)
    return kept


def fit(rows: list[np.ndarray], toxic: np.ndarray) -> Ordinal:
    """Rows: each document's distinct buckets; toxic: 0 or 1."""
    weights = np.zeros(BUCKETS, np.float32)
    cuts = np.array([1.0, 2.0]) * 8
    kept = unlike(rows)
    rows, toxic = [rows[k] for k in kept], toxic[kept]
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    if not n1 or not n0:
        return Ordinal(weights, cuts)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    seen1 = np.bincount(flat, toxic[owner], BUCKETS)
    seen = np.bincount(flat, minlength=BUCKETS)
    share = n1 / len(toxic)
    z = (seen1 - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    picked = np.flatnonzero((seen >= max(LEAST_ROWS, LEAST_SHARE * len(toxic))) & (np.abs(z) >= STANDS_OUT))
    if not len(picked):
        return Ordinal(weights, cuts)
    column = np.full(BUCKETS, -1)
    column[picked] = np.arange(len(picked))
    use = column[flat] >= 0
    i, j = owner[use], column[flat[use]]
    # severity grades of the sample: how many distinct toxic-associated words
    telling = np.bincount(owner[use & (z[flat] > 0)], minlength=len(rows))
    middle = float(np.median(telling[toxic == 1]))
    grade = np.where(toxic == 1, 1 + (telling > middle), 0)
    w = np.sign(z[picked]) * FULL_WEIGHT * np.minimum(1.0, seen[picked] / FULL_ROWS)
    t = np.array([FIRST_CUT, max(FIRST_CUT + 1, FULL_WEIGHT * (middle + 0.5))])
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for step in range(1, STEPS + 1):
        eta = np.bincount(i, w[j], len(rows))
        up = 1 / (1 + np.exp(-(eta[:, None] - t[None, :])))
        above = np.concatenate([np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))], 1)
        p = np.maximum(np.take_along_axis(above, grade[:, None], 1) - np.take_along_axis(above, grade[:, None] + 1, 1), 1e-12)[:, 0]
        slope = np.concatenate([np.zeros((len(rows), 1)), up * (1 - up), np.zeros((len(rows), 1))], 1)
        lo = np.take_along_axis(slope, grade[:, None], 1)[:, 0] / p
        hi = np.take_along_axis(slope, grade[:, None] + 1, 1)[:, 0] / p
        g = (hi - lo) / len(rows)
        gw = np.bincount(j, g[i], len(picked)) + SHRINK * w / len(picked)
        gt = np.array([(np.where(grade == k, lo, 0) - np.where(grade == k - 1, hi, 0)).sum() / len(rows) for k in (1, 2)])
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / STEPS))
        for x, gx, m, v in ((w, gw, mw, vw), (t, gt, mt, vt)):
            m += 0.1 * (gx - m)
            v += 0.01 * (gx * gx - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        t[1] = max(t[1], t[0] + 1e-3)
    weights[picked] = w
    return Ordinal(weights, t)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns plus `buckets`: each document's distinct word buckets."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", buckets array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(_bucket)
        for batch in batches:
            found = []
            for raw in texts(batch.column("text")):
                ws = set(words(raw))
                found.append(np.unique(np.fromiter(map(known.__getitem__, ws), np.int32, len(ws))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.list_(pa.int32()))], [*keep, "buckets"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on at most sample_rows labelled documents, those with the smallest hash of doc_id.

    A doc_id with several texts or repeated rows counts once, with its smallest text, before the limit is taken.
    """
    sample = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # the sample is at most sample_rows pairs of numbers
    once = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    got = features(once, ["doc_id", "label"]).toPandas().sort_values("doc_id")
    return fit([np.asarray(x, np.int64) for x in got["buckets"]], got["label"].to_numpy(np.int64).clip(0, 1))


def _scorer(model: Ordinal):
    used = np.flatnonzero(model.weights)
    weight = dict(zip(used.tolist(), model.weights[used].tolist(), strict=True))

    def run(column: pa.Array) -> np.ndarray:
        eta = np.empty(len(column))
        for k, raw in enumerate(texts(column)):
            eta[k] = sum(weight.get(known[w], 0.0) for w in sorted(set(words(raw))))
        return model_levels(eta)

    known = Memo(_bucket)
    cuts = model.cuts

    def model_levels(eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(eta[:, None] - cuts[None, :])))

    return run


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, p_toxic, expected_severity, grade, toxic) of every document."""
    small = _compact(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _scorer(small())
        for batch in batches:
            p = levels(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p[:, 0].round(6)), pa.array(p.sum(1).round(6)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= TOXIC_AT)],
                ["doc_id", "p_toxic", "expected_severity", "grade", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    small = _compact(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _scorer(small())
        for batch in batches:
            yield batch.filter(pa.array(levels(batch.column("text"))[:, 0] < TOXIC_AT))

    return docs.mapInArrow(run, docs.schema)


def _compact(model: Ordinal):
    """The model as a few numbers that travel with the tasks: only buckets with weight."""
    used = np.flatnonzero(model.weights)
    values, cuts = model.weights[used], model.cuts

    def whole() -> Ordinal:
        weights = np.zeros(BUCKETS, np.float32)
        weights[used] = values
        return Ordinal(weights, cuts)

    return whole
