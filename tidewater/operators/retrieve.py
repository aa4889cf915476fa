"""Exact nearest reviews by cosine, and the evidence an answer cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import text as X
from tidewater.operators.reviews import scope


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine to a fixed vector in double; null for null, empty or zero vectors."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    norm = float(sum(x * x for x in map(float, query))) ** 0.5
    dot = F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(own * F.lit(norm), F.lit(0.0))


def scored(reviews: DataFrame, query: list[float], brand: str | None = None) -> DataFrame:
    rows = scope(reviews, brand).where("embedding is not null")
    return with_score(rows, query)


def with_score(rows: DataFrame, query: list[float]) -> DataFrame:
    """Adds `exact`, by which rows are ordered, and `score`, which is shown."""
    return rows.withColumn("exact", cosine(F.col("embedding"), query)).where("exact is not null").withColumn("score", F.round("exact", 6))


def nearest(reviews: DataFrame, query: list[float], brand: str | None = None, k: int = 8) -> DataFrame:
    """The k nearest, exactly: a scan and a top-k, no shuffle of the table."""
    rows = scored(reviews, query, brand).orderBy(F.desc("exact"), "id").limit(k)
    return rows.select("id", "brand", "source", "source_url", "author", "rating", "sentiment", "text", "score", "exact")


def nearest_of_brands(reviews: DataFrame, query: list[float], brands: list[str], k: int = 8) -> DataFrame:
    """A slice for each brand, in the order given; the first of equal (url, text) stays. No global re-sort."""
    per = max(3, k // len(brands) + 2)
    # one scan, whatever the number of brands; a review may belong to several of them, as names may hold wildcards
    wanted = F.filter(F.array(*[F.when(F.col("brand").ilike(b), F.lit(i)) for i, b in enumerate(brands)]), lambda i: i.isNotNull())
    rows = scored(reviews.where(F.size(wanted) > 0), query).withColumn("brand_no", F.explode(wanted))
    place = F.row_number().over(Window.partitionBy("brand_no").orderBy(F.desc("exact"), "id"))
    # at most `per` rows a brand leave each task before the window's shuffle
    rows = rows.withColumn("place", place).where(F.col("place") <= per)
    rows = rows.select("id", "brand", "source", "source_url", "author", "rating", "sentiment", "text", "score", "exact", "brand_no", "place")
    once = F.row_number().over(Window.partitionBy("source_url", "text").orderBy("brand_no", "place"))
    return rows.withColumn("_once", once).where("_once = 1").drop("_once").orderBy("brand_no", "place")


def confidence(found: DataFrame) -> DataFrame:
    """High, Medium or Low by the best score and the number of rows, with the distinct sources."""
    types = F.array_sort(F.collect_set(F.nullif(F.col("source"), F.lit(""))))
    facts = found.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top"), F.count("*").alias("reviews"), types.alias("source_types"))
    grade = F.when((F.col("top") >= 0.5) & (F.col("reviews") >= 3), "High").when((F.col("top") >= 0.35) & (F.col("reviews") >= 2), "Medium").otherwise("Low")
    return facts.select(grade.alias("confidence"), "reviews", F.size("source_types").alias("sources"), F.array_join("source_types", ",").alias("source_types"))


def numbered(found: DataFrame) -> DataFrame:
    return found.withColumn("n", F.row_number().over(Window.orderBy(F.desc("exact"), "id")))  # top-k rows only


def context(found: DataFrame) -> DataFrame:
    """One text of numbered blocks for a generator."""
    head = F.concat(
        F.lit("["), F.col("n").cast("string"), F.lit("] brand: "), F.col("brand"), F.lit(" | source: "), F.col("source"),
        F.coalesce(F.concat(F.lit(" | rating: "), F.col("rating").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(" | sentiment: "), F.nullif(F.col("sentiment"), F.lit(""))), F.lit("")),
        F.lit(" | url: "), F.col("source_url"), F.lit("\n"), X.strip(F.col("text")),
    )
    blocks = F.array_sort(F.collect_list(F.struct("n", head.alias("block"))))
    return numbered(found).agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))


def extractive(found: DataFrame, most: int = 5) -> DataFrame:
    """Quoted lines with their citation numbers: the answer where no generator is at hand."""
    rows = numbered(found).where(F.col("n") <= most)
    return rows.select("n", F.concat(F.lit("- "), X.quote(F.col("text")), F.lit(" ["), F.col("n").cast("string"), F.lit("]")).alias("line")).orderBy("n")


def citations(found: DataFrame) -> DataFrame:
    return numbered(found).select("n", "source", "source_url", "author", "rating", X.excerpt(F.col("text"), 280, "…").alias("excerpt"), "score").orderBy("n")
