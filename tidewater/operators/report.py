"""Report facts and saved snapshots."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators import reviews as R


def facts(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    """Total, sentiment, rating and health of a report."""
    rows = R.scope(reviews, brand).agg(F.count("*").alias("total"), *R.label_counts(), F.bround(F.avg("rating"), 2).alias("avg_rating"))
    score = X.health_score(F.col("positive"), F.col("neutral"), F.col("negative"), F.col("avg_rating"))
    return rows.withColumn("health", score).withColumn("health_label", X.health_label(F.col("health")))


def lenient_object(reply: str | F.Column) -> F.Column:
    """A JSON object in a generator's reply: the whole text, or from the first brace to the last."""
    text = F.col(reply) if isinstance(reply, str) else reply
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(text), valid(inner))


def save(spark: SparkSession, path: str, brand: str, payload: str, created_at: str) -> str:
    """Append a snapshot and return its token; an empty report is refused."""
    if not payload or payload.strip() in ("", "{}", "null"):
        raise ValueError("nothing to save")
    token = secrets.token_urlsafe(16)
    row = spark.createDataFrame([(brand, created_at, payload, token)], "brand string, created string, payload string, token string")
    row.select("brand", F.to_timestamp("created").alias("created_at"), "payload", "token").write.mode("append").parquet(path)
    return token


def saved(snapshots: DataFrame, brand: str | None = None, limit: int = 50) -> DataFrame:
    rows = R.of_brand(snapshots, brand).orderBy(F.desc("created_at"), "token").limit(max(1, min(limit, 200)))
    return rows.select("brand", "created_at", "token")


def shared(snapshots: DataFrame, token: str) -> DataFrame:
    """The snapshot of a token; no row if there is none."""
    return snapshots.where(F.col("token") == token).limit(1)
