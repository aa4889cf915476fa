"""Review-shaped rows from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.schema import content_key
from tidewater.functions.taxonomy import SOURCES, TRUSTED

NAMES = [s for s, _, _ in SOURCES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, embedded: bool = False) -> DataFrame:
    """One review for each document. Joins are on keys; row counts of small tables come from Parquet footers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("source_url"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "user_id", "ts")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    n_pages = pages.count()
    source = F.element_at(F.array(*map(F.lit, NAMES)), (F.substring("source", 4, 9).cast("int") % 17 + 1))
    rows = (
        docs.withColumn("page_id", F.col("doc_id") % n_pages)
        .join(pages, "page_id", "left")
        .join(events, "doc_id", "left")
        .join(orders, "doc_id", "left")
        .join(labels, "doc_id", "left")
        .withColumn("source", source)
    )
    starred = F.col("source").isin(TRUSTED)
    stars = (
        F.when(F.col("quality").isNull(), 1 + F.col("doc_id") % 5)
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), 5)
        .when(F.col("quality") == 1, 3)
        .when(F.col("toxic") == 0, 2)
        .otherwise(1)
    )
    rating = F.when(starred, stars.cast("double"))
    mood = F.when((F.col("doc_id") % 5).isin(0, 1), "positive").when(F.col("doc_id") % 5 == 2, "neutral").otherwise("negative")
    brand = F.concat(F.lit("Brand#"), (1 + F.col("doc_id") % 25).cast("string"))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    out = rows.select(
        "doc_id",
        content_key(brand, F.col("source"), F.col("source_url"), F.col("text")).alias("id"),
        brand.alias("brand"),
        "source",
        "source_url",
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("author"),
        rating.alias("rating"),
        "text",
        F.when(rating >= 3.5, "positive").when(rating <= 2.5, "negative").when(rating.isNotNull(), "neutral").otherwise(mood).alias("sentiment"),
        F.date_format("o_orderdate", iso).alias("created_at"),
        F.date_format("ts", iso).alias("captured_at"),
        F.when(starred, True).when(F.col("quality").isNotNull(), F.col("quality") == 1).alias("relevant"),
        (F.col("doc_id") % 4 == 0).alias("qc_checked"),
    )
    if not embedded:
        return out
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding")
    return out.withColumn("vec_id", F.col("doc_id") % vectors.count()).join(vectors, "vec_id", "left").drop("vec_id")


_NAMES = ", ".join(f"'{n}'" for n in NAMES)
_TRUSTED = ", ".join(f"'{n}'" for n in TRUSTED)

REVIEWS_SQL = f"""
base AS (
    SELECT d.doc_id, d.text, d.brand, d.source, p.url AS source_url, e.user_id, e.ts, o.o_orderdate, l.quality, l.toxic, d.source IN ({_TRUSTED}) AS starred
    FROM (SELECT doc_id, text, 'Brand#' || (1 + doc_id % 25) AS brand, [{_NAMES}][CAST(substring(source, 4) AS INTEGER) % 17 + 1] AS source FROM documents) d
    LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
    LEFT JOIN events e ON e.event_id = d.doc_id
    LEFT JOIN orders o ON o.o_orderkey = d.doc_id
    LEFT JOIN labels l ON l.doc_id = d.doc_id),
rated AS (
    SELECT *, CASE WHEN NOT starred THEN NULL WHEN quality IS NULL THEN 1 + doc_id % 5 WHEN quality = 1 AND toxic = 0 THEN 5 WHEN quality = 1 THEN 3 WHEN toxic = 0 THEN 2 ELSE 1 END::DOUBLE AS rating FROM base),
reviews AS (
    SELECT doc_id, sha256(brand || '|' || source || '|' || coalesce(source_url, 'None') || '|' || text) AS id, brand, source, source_url,
        CASE WHEN doc_id % 7 <> 0 THEN 'user' || user_id END AS author, rating, text,
        CASE WHEN rating >= 3.5 THEN 'positive' WHEN rating <= 2.5 THEN 'negative' WHEN rating IS NOT NULL THEN 'neutral'
             WHEN doc_id % 5 IN (0, 1) THEN 'positive' WHEN doc_id % 5 = 2 THEN 'neutral' ELSE 'negative' END AS sentiment,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS captured_at,
        CASE WHEN starred THEN true WHEN quality IS NOT NULL THEN quality = 1 END AS relevant, doc_id % 4 = 0 AS qc_checked
    FROM rated)
"""
