"""Word and text vectors learnt from a corpus: words that keep like company lie near each other.

Which words stand near which is counted in Spark; the counts become positive pointwise mutual information,
and its leading directions are found by random projection: tasks multiply the sparse matrix, the driver
orthogonalises a matrix of bounded size. A text is the mean of its words' vectors, rarer words weighing more.

The fit reads at most `sample_rows` documents (those of least hash) and the `most_words` commonest words;
vectors are then made for every text. Cases: null texts have no words; texts without a known word get the hashed
stand-in of `enrich.hashed`; equal counts go by word; an empty corpus gives a model without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators.enrich import Embedder, hashed

SAMPLE_ROWS = 200_000
MOST_WORDS = 50_000
WINDOW = 4


def vocabulary(docs: DataFrame, most_words: int = MOST_WORDS, least: int = 5) -> list[tuple[str, int]]:
    """The commonest words with their numbers of occurrences: a list of bounded length."""
    words = docs.select(F.explode(X.words(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [(r["word"], r["n"]) for r in words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most_words).collect()]


def pair_counts(docs: DataFrame, words: list[str], window: int = WINDOW) -> DataFrame:
    """Rows (a, b, c): how often word b stands within `window` words of word a, nearer ones counting more."""
    held = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})
    size, word = len(words), X.WORD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gap = held.value, [-1] * window
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                ids = []
                for text in batch.column("text").slice(s, 500).to_pylist():
                    ids += [number.get(w, -1) for w in regex.findall(word, (text or "").lower())] + gap
                ids = np.array(ids, np.int64)
                keys, weights = [], []
                for d in range(1, window + 1):
                    a, b = ids[:-d], ids[d:]
                    good = (a >= 0) & (b >= 0)
                    keys += [a[good] * size + b[good], b[good] * size + a[good]]
                    weights += [np.full(2 * int(good.sum()), window + 1 - d, np.int64)]
                key, where = np.unique(np.concatenate(keys), return_inverse=True)
                c = np.bincount(where, np.concatenate(weights), len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key // size), pa.array(key % size), pa.array(c)], ["a", "b", "c"])

    return docs.select("text").mapInArrow(count, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def information(pairs: DataFrame) -> DataFrame:
    """Rows (a, b, m): positive pointwise mutual information of the pairs."""
    sums = pairs.groupBy("a").agg(F.sum("c").alias("n"))
    total = sums.agg(F.sum("n").alias("total"))
    left, right = sums.select("a", F.col("n").alias("na")), sums.select(F.col("a").alias("b"), F.col("n").alias("nb"))
    rows = pairs.join(left, "a").join(right, "b").crossJoin(total)  # one row
    m = F.log(F.col("c") * F.col("total") / (F.col("na") * F.col("nb").cast("double")))
    return rows.select("a", "b", m.alias("m")).where("m > 0")


def times(matrix: DataFrame, right: np.ndarray) -> np.ndarray:
    """The sparse matrix (a, b, m) times a dense one of bounded size; tasks sum what they hold."""
    held = matrix.sparkSession.sparkContext.broadcast(right)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, sums = held.value, {}
        for batch in batches:
            a, b, m = (batch.column(c).to_numpy() for c in ("a", "b", "m"))
            for s in range(0, len(a), 50_000):
                part = slice(s, s + 50_000)
                row, where = np.unique(a[part], return_inverse=True)
                made = np.zeros((len(row), dense.shape[1]))
                np.add.at(made, where, m[part, None] * dense[b[part]])
                for k, v in zip(row.tolist(), made, strict=True):
                    sums[k] = sums[k] + v if k in sums else v
        for k in range(0, len(sums), 1000):
            some = list(sums.items())[k : k + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([v.tolist() for _, v in some], pa.list_(pa.float64()))], ["a", "v"])

    # rows of one word go to one task, so that each word comes back once
    rows = matrix.repartition("a").mapInArrow(multiply, "a long, v array<double>").toArrow()
    out = np.zeros(right.shape)
    if rows.num_rows:
        out[rows.column("a").to_numpy()] = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, right.shape[1])
    return out


@dataclass
class Meaning:
    words: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray

    def nearest(self, word: str, k: int = 5) -> list[str]:
        at = self.words[word]
        norm = np.linalg.norm(self.vectors, axis=1)
        score = self.vectors @ self.vectors[at] / np.maximum(norm * norm[at], 1e-12)
        names = list(self.words)
        return [names[i] for i in np.argsort(-score, kind="stable") if i != at][:k]

    def embedder(self) -> Embedder:
        """A provider for `enrich.embed`: unit vectors of texts."""
        words, vectors, weights, spare, word = self.words, self.vectors, self.weights, hashed(self.vectors.shape[1]), X.WORD

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), vectors.shape[1]), np.float32)
            for k, text in enumerate(texts):
                ids = [i for i in (words.get(w) for w in regex.findall(word, text.lower())) if i is not None]
                mean = (vectors[ids] * weights[ids, None]).sum(0) if ids else np.zeros(vectors.shape[1])
                norm = np.linalg.norm(mean)
                out[k] = mean / norm if norm > 0 else spare([text])[0]
            return out

        return run


def fit(docs: DataFrame, dimensions: int = 64, sample_rows: int = SAMPLE_ROWS, most_words: int = MOST_WORDS, window: int = WINDOW, least: int = 5, rounds: int = 2, seed: int = 0) -> Meaning:
    """Vectors of the commonest words of a sample."""
    sample = docs.select("text").orderBy(F.xxhash64("text"), "text").limit(sample_rows).cache()
    counted = vocabulary(sample, most_words, least)
    words = [w for w, _ in counted]
    if not words:
        return Meaning({}, np.zeros((0, dimensions)), np.zeros(0))
    matrix = information(pair_counts(sample, words, window)).cache()
    width = min(len(words), dimensions + 10)
    basis = np.random.default_rng(seed).standard_normal((len(words), width))
    for _ in range(rounds + 1):
        basis, _ = np.linalg.qr(times(matrix, basis))
    values, turn = np.linalg.eigh(basis.T @ times(matrix, basis))
    top = np.argsort(-np.abs(values), kind="stable")[:dimensions]
    vectors = basis @ turn[:, top] * np.sqrt(np.abs(values[top]))
    matrix.unpersist()
    sample.unpersist()
    n = np.array([c for _, c in counted], float)
    share = n / n.sum()
    full = np.zeros((len(words), dimensions))
    full[:, : vectors.shape[1]] = vectors
    return Meaning({w: k for k, w in enumerate(words)}, full, 1e-3 / (1e-3 + share))
