"""Which notices new negative reviews call for, as rows: the batch form of the streaming operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import text as X

#: Single alerts a brand gets in one pass; the rest is one notice.
PER_PASS = 5


def plan(reviews: DataFrame, alerted: DataFrame, seen: DataFrame, per_pass: int = PER_PASS) -> DataFrame:
    """Notices (brand, kind, id, n): a baseline for a brand's first pass, else up to per_pass alerts and an overflow.

    `alerted` holds ids already alerted, `seen` brands with a baseline. All fresh ids count as alerted
    afterwards, see `remember`.
    """
    new = fresh(reviews, alerted).join(seen.select("brand", F.lit(True).alias("known")), "brand", "left")
    baseline = new.where("known is null").groupBy("brand").agg(F.count("*").alias("n")).select("brand", F.lit("baseline").alias("kind"), F.lit(None).cast("string").alias("id"), "n")
    later = new.where("known")
    # the newest ones are a top-k of each brand, the overflow a count: no brand is sorted whole
    order = Window.partitionBy("brand").orderBy(F.col("captured_at").desc_nulls_first(), "id")
    alerts = later.select("brand", "id", F.row_number().over(order).alias("place")).where(F.col("place") <= per_pass).select("brand", F.lit("alert").alias("kind"), "id", F.lit(1).cast("long").alias("n"))
    rest = later.groupBy("brand").agg((F.count("*") - per_pass).alias("n")).where("n > 0").select("brand", F.lit("overflow").alias("kind"), F.lit(None).cast("string").alias("id"), "n")
    return baseline.unionByName(alerts).unionByName(rest)


def fresh(reviews: DataFrame, alerted: DataFrame) -> DataFrame:
    """Negative reviews with an id that has not been alerted, each once."""
    rows = reviews.where((F.col("sentiment") == "negative") & F.col("id").isNotNull()).withColumn("brand", F.coalesce("brand", F.lit("?")))
    # of rows that share an id, the newest one, whatever the order in which they come
    columns = [c for c in rows.columns if c != "id"]
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("captured_at", "brand")).alias("_row")).select("id", "_row.*").select(rows.columns)
    return newest.join(alerted.select("id"), "id", "left_anti")


def remember(reviews: DataFrame, alerted: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after a pass: (alerted, seen)."""
    new = fresh(reviews, alerted)
    return alerted.select("id").unionByName(new.select("id")), seen.select("brand").unionByName(new.select("brand")).distinct()


def message(reviews: DataFrame) -> DataFrame:
    """The text of single alerts."""
    stars = F.coalesce(F.concat(F.col("rating").cast("string"), F.lit("/5 ")), F.lit(""))
    body = X.excerpt(F.replace(X.strip(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" ")), 200, "...")
    return reviews.select("id", F.concat(F.lit("New negative review, "), F.col("brand"), F.lit("\n"), stars, F.lit("on "), F.col("source"), F.lit('\n"'), body, F.lit('"\n'), F.col("source_url")).alias("message"))
