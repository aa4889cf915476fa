"""Sentiment and embeddings of pending rows; models are providers with offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import text as X
from tidewater.operators.store import pending_enrichment

#: Texts that one call of an embedding provider takes.
CALL_TEXTS = 96

Embedder = Callable[[list[str]], np.ndarray]


def hashed(dimensions: int = 64) -> Embedder:
    """A stand-in for a model: signed counts of hashed words, unit length. It carries no meaning."""

    def run(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dimensions), np.float32)
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[k, h % dimensions] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return run


def embed(rows: DataFrame, provider: Embedder | None = None, text: str = "text") -> DataFrame:
    """Adds `embedding`; a provider gets at most CALL_TEXTS prepared texts at once, in order."""
    call = provider or hashed()
    prepared = rows.withColumn("_prepared", X.embed_text(F.col(text)))
    names = [c for c in rows.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_prepared").to_pylist()
            parts = [np.asarray(call(texts[s : s + CALL_TEXTS]), np.float32) for s in range(0, len(texts), CALL_TEXTS)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], [*names, "embedding"])

    schema = prepared.select(*names).schema.add("embedding", T.ArrayType(T.FloatType()))
    return prepared.select(*names, "_prepared").mapInArrow(run, schema)


def enriched(raw: DataFrame, served: DataFrame, provider: Embedder | None = None, lexicon: dict[str, float] | None = None) -> DataFrame:
    """Pending raw rows in the served shape: one set-based pass instead of small batches."""
    pending = pending_enrichment(raw, served)
    scored = pending.withColumn("sentiment", X.sentiment(F.col("rating"), F.col("text"), lexicon))
    rows = embed(scored, provider).withColumn("relevant", F.lit(None).cast("boolean")).withColumn("qc_checked", F.lit(False))
    return rows.select([c for c in served.columns if c in rows.columns])


Judge = Callable[[str, list[str]], list[tuple[int, bool, str]]]


def judge(pending: DataFrame, provider: Judge, batch_rows: int = 25, cut: int = 600) -> DataFrame:
    """Verdicts (id, relevant, sentiment) of a provider that sees up to batch_rows texts of one brand a call.

    Rows are dealt by brand and hash, so a large brand is judged in many tasks; a call never mixes brands.
    """
    dealt = pending.select("id", "brand", F.substring("text", 1, cut).alias("text")).repartition("brand", F.pmod(F.xxhash64("id"), F.lit(64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_brand: dict[str, list[tuple[str, str]]] = {}
            for row in batch.to_pylist():
                by_brand.setdefault(row["brand"], []).append((row["id"], row["text"]))
            out = []
            for brand, rows in by_brand.items():
                for s in range(0, len(rows), batch_rows):
                    part = rows[s : s + batch_rows]
                    out += [(part[i][0], bool(ok), said) for i, ok, said in provider(brand, [t for _, t in part]) if 0 <= i < len(part)]
            ids, oks, says = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(oks, pa.bool_()), pa.array(says, pa.string())], ["id", "relevant", "sentiment"])

    return dealt.mapInArrow(run, "id string, relevant boolean, sentiment string")


def collection_tally(batch: DataFrame, loaded: DataFrame, target: int = 200, floor: int = 150) -> DataFrame:
    """New rows of a collection run by source, its distinct new ids, and whether target and floor are met."""
    fresh = batch.join(loaded.select("id"), "id", "left_anti")
    by_source = fresh.groupBy("source").agg(F.count("*").alias("new_rows"))
    ids = fresh.agg(F.count_distinct("id").alias("new_ids"))
    return by_source.crossJoin(ids).withColumns({"at_target": F.col("new_ids") >= target, "at_floor": F.col("new_ids") >= floor})
