"""Upserts and keyed updates as plans, quality checks, pending rows, run history. `tables` keeps the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.taxonomy import TRUSTED

RAW_UPDATES = ["captured_at", "rating", "extra"]
SERVED_UPDATES = ["text", "rating", "sentiment", "embedding", "captured_at"]


def upsert(base: DataFrame, batch: DataFrame, updates: list[str], seq: str = "seq") -> DataFrame:
    """base with batch laid over it by id: new ids are inserted, known ones change in `updates` only.

    The last row of an id (by seq) gives the updated columns; a new id's other columns come from its
    first row, as if rows had been applied one by one. One aggregate and one join on id.
    """
    columns = base.columns
    rows = batch.select(seq, *columns)
    fixed = [c for c in columns if c != "id" and c not in updates]
    last = F.max_by(F.struct(*updates), seq).alias("last")
    first = F.min_by(F.struct(*fixed), seq).alias("first")
    new = rows.groupBy("id").agg(last, first)
    old = base.select("id", F.struct(*[c for c in columns if c != "id"]).alias("old"))
    both = old.join(new, "id", "full")
    pick = lambda c: (
        F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(f"old.{c}"))
        if c in updates
        else F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"first.{c}"))
    )
    return both.select(*[F.col("id") if c == "id" else pick(c).alias(c) for c in columns])


def raw_upsert(base: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(base, batch, RAW_UPDATES)


def served_upsert(base: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(base, batch, SERVED_UPDATES)


def trust_sources(served: DataFrame) -> DataFrame:
    """Unchecked rows of a brand's own pages become relevant and checked."""
    hit = ~F.coalesce("qc_checked", F.lit(False)) & F.col("source").isin(TRUSTED)
    return served.withColumns({"relevant": F.when(hit, True).otherwise(F.col("relevant")), "qc_checked": F.when(hit, True).otherwise(F.col("qc_checked"))})


def pending_checks(served: DataFrame, brand: str | None = None, limit: int = 600) -> DataFrame:
    """Unchecked rows of other sources, newest first; the limit is the feature."""
    rows = served if brand is None else served.where(F.col("brand").ilike(brand))
    rows = rows.where(~F.coalesce("qc_checked", F.lit(False)) & ~F.col("source").isin(TRUSTED))
    return rows.orderBy(F.col("captured_at").desc_nulls_first(), "id").limit(max(1, min(limit, 5000)))


def apply_verdicts(served: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Lay verdicts (id, relevant, sentiment) over rows; star-derived sentiment stays.

    Of several verdicts on a row the last one by `seq` holds; without that column the largest, so that runs repeat.
    """
    said = F.struct("relevant", "sentiment")
    last = F.max_by(said, F.struct("seq", said)) if "seq" in verdicts.columns else F.max(said)
    v = verdicts.groupBy("id").agg(last.alias("v"))
    rows = served.join(v, "id", "left")
    judged = F.col("v").isNotNull()
    return rows.withColumns(
        {
            "relevant": F.when(judged, F.col("v.relevant")).otherwise(F.col("relevant")),
            "sentiment": F.when(judged & F.col("rating").isNull(), F.col("v.sentiment")).otherwise(F.col("sentiment")),
            "qc_checked": F.when(judged, True).otherwise(F.col("qc_checked")),
        }
    ).select(*served.columns)


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """Verdicts of judges' replies: columns ids (the rows of a call in order) and reply (JSON text).

    Bad or missing indexes are skipped, unknown sentiments are neutral; only false, zero, null and
    empty values mean not relevant.
    """
    items = F.from_json(F.get_json_object("reply", "$.items"), "array<string>")
    rows = replies.select("ids", F.explode(items).alias("item"))
    at = F.coalesce(F.get_json_object("item", "$.i").try_cast("int"), F.get_json_object("item", "$.i").try_cast("double").cast("int"))
    said = F.get_json_object("item", "$.relevant")
    sentiment = F.lower(F.coalesce(F.get_json_object("item", "$.sentiment"), F.lit("neutral")))
    rows = rows.select("ids", at.alias("at"), said.alias("said"), sentiment.alias("sentiment")).where((F.col("at") >= 0) & (F.col("at") < F.size("ids")))
    relevant = F.coalesce(~F.col("said").isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))
    return rows.select(F.element_at("ids", F.col("at") + 1).alias("id"), relevant.alias("relevant"), F.when(F.col("sentiment").isin("positive", "neutral", "negative"), F.col("sentiment")).otherwise("neutral").alias("sentiment"))


def pending_enrichment(raw: DataFrame, served: DataFrame) -> DataFrame:
    """Raw rows that are not served yet, or with another text; texts are told apart by their SHA-256, so that served ones stay where they are."""
    known = served.select("id", F.sha2("text", 256).alias("_served"))
    return raw.join(known, "id", "left").where(F.col("_served").isNull() | (F.col("_served") != F.sha2("text", 256))).drop("_served")


def append_run(spark: SparkSession, path: str, brand: str, sources: list[str], rows: int, status: str, started: str, finished: str) -> None:
    """One row of run history; times are ISO text."""
    row = spark.createDataFrame([(brand, ", ".join(sources), rows, status, started, finished)], "brand string, sources string, reviews_found int, status string, started string, finished string")
    ms = (F.unix_micros(F.to_timestamp("finished")) - F.unix_micros(F.to_timestamp("started"))) / 1000
    row.select("brand", "sources", "reviews_found", "status", ms.cast("int").alias("duration_ms"), F.to_timestamp("started").alias("started_at"), F.to_timestamp("finished").alias("finished_at")).write.mode("append").parquet(path)


def runs(history: DataFrame, limit: int = 50, brand: str | None = None) -> DataFrame:
    """The newest runs, of all brands or of one; the limit is the feature."""
    rows = history if brand is None else history.where(F.col("brand").ilike(brand))
    return rows.orderBy(F.desc("started_at"), "brand").limit(max(1, min(limit, 200)))
