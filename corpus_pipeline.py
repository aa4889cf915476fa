"""From raw documents to packed training sequences: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontamination, linededup, packing, simhash, toxicity
from tidewater.llm.common import SCRATCH, persist, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression calls toxic go; null and empty texts stay, each row is judged alone."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; so do documents of which no word is left. Null texts stay as they are."""
    done = linededup.dedup_lines(docs)
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[\p{L}\p{N}]")
    kept = done.where(F.col("text").isNull() | ~empty)
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least doc_id, null last; null and empty texts stay."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the question and answer of a benchmark item go; null and empty texts stay, items that repeat count once."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens; a null or empty text is its closing id alone."""
    return packing.pack_documents(docs, window=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages need hashes, regression and tokenisation that SQL has no words for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = table(spark, sf_dir, "documents"), len(SCRATCH)
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), name)
        release(spark, begun, keep=1)  # the stage's own tables and its predecessor's result
    return STAGES[-1][1](spark, docs, sf_dir)
