"""Filters, ordered lists and counts over the served reviews."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import text as X
from tidewater.sources.config import clamp

LABELS = ["positive", "neutral", "negative"]


def of_brand(reviews: DataFrame, brand: str | None) -> DataFrame:
    """Case-insensitive; % and _ in the name are wildcards. No name: all rows, with no predicate."""
    return reviews if brand is None else reviews.where(F.col("brand").ilike(brand))


def relevant_only(reviews: DataFrame) -> DataFrame:
    """Rows judged relevant and rows not judged."""
    return reviews.where(~F.col("relevant").eqNullSafe(F.lit(False)))


def scope(reviews: DataFrame, brand: str | None = None, source: str | None = None, relevant: bool = True) -> DataFrame:
    rows = of_brand(reviews, brand)
    rows = relevant_only(rows) if relevant else rows
    return rows.where(F.col("source") == source) if source else rows


def _rank(first: str, second: str) -> Column:
    return F.when(F.col("sentiment") == first, 0).when(F.col("sentiment") == second, 1).otherwise(2)




def orders() -> dict[str, list[Column]]:
    """Sort keys; all end in id, so that limits are repeatable."""
    newest, by_id = F.col("captured_at").desc_nulls_first(), F.col("id").asc()
    return {
        "recent": [newest, by_id],
        "oldest": [F.col("captured_at").asc_nulls_last(), by_id],
        "rating_high": [F.col("rating").desc_nulls_last(), newest, by_id],
        "rating_low": [F.col("rating").asc_nulls_last(), newest, by_id],
        "negative": [_rank("negative", "neutral").asc(), newest, by_id],
        "positive": [_rank("positive", "neutral").asc(), newest, by_id],
        "platform": [F.col("source").asc_nulls_last(), X.platform_host(F.col("source_url")).asc_nulls_last(), _rank("negative", "neutral").asc(), newest, by_id],
    }


def listed(reviews: DataFrame, brand: str | None = None, sort: str = "recent", limit: int = 40, source: str | None = None) -> DataFrame:
    """A page of reviews; the limit is the feature. Unknown sorts mean recent."""
    by = orders().get(sort, orders()["recent"])
    rows = scope(reviews, brand, source).orderBy(*by).limit(clamp(limit, 1, 200))
    return rows.select("id", "brand", "source", "source_url", "author", "rating", "sentiment", X.excerpt(F.col("text"), 240, "…").alias("excerpt"), "captured_at")


def recent_negative(reviews: DataFrame, brand: str | None = None, limit: int = 12) -> DataFrame:
    rows = scope(reviews, brand).where(F.col("sentiment") == "negative").orderBy(*orders()["recent"]).limit(limit)
    return rows.select("id", "source", "source_url", "rating", X.excerpt(F.col("text"), 240, "…").alias("excerpt"))


def sample(reviews: DataFrame, brand: str | None = None, limit: int = 60) -> DataFrame:
    """The newest reviews, relevant or not, for text mining."""
    return of_brand(reviews, brand).where("text is not null").orderBy(*orders()["recent"]).limit(limit)


def balanced_sample(reviews: DataFrame, brand: str | None = None, limit: int = 24) -> DataFrame:
    """Numbered evidence: negative, then positive, then others, newest first, relevant or not."""
    rank = _rank("negative", "positive")
    by = [rank.asc(), F.col("captured_at").desc_nulls_first(), F.col("id").asc()]
    rows = of_brand(reviews, brand).where("text is not null").orderBy(*by).limit(limit)
    return rows.withColumn("n", F.row_number().over(Window.orderBy(*by))).select(
        "n", "id", "source", "source_url", "rating", "sentiment", X.excerpt(F.col("text"), 220, "...").alias("excerpt")
    )


def by_platform(numbered: DataFrame) -> DataFrame:
    host = F.regexp_replace(X.platform_host(F.col("source_url")), r"^www\.", "")
    return numbered.orderBy("source", host, "n")


def export_rows(reviews: DataFrame, brand: str | None = None, source: str | None = None, limit: int = 5000) -> DataFrame:
    """Nine columns as text, newest first, relevant or not; nulls are empty."""
    columns = ["brand", "source", "source_url", "author", "rating", "sentiment", "text", "created_at", "captured_at"]
    rows = scope(reviews, brand, source, relevant=False).orderBy(*orders()["recent"]).limit(clamp(limit, 1, 50_000))
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """One quoted CSV file with a header; rows are at most 50,000."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("multiLine", True).csv(path)


# ---- counts


def label_counts() -> list[Column]:
    return [F.count_if(F.col("sentiment") == x).alias(x) for x in LABELS]


def total(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    return scope(reviews, brand).agg(F.count("*").alias("total"))


def flagged(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    return of_brand(reviews, brand).agg(F.count_if(F.col("relevant") == False).alias("flagged"))  # noqa: E712


def sentiment_counts(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    """Three labels, zero where there are none; others are not counted."""
    counts = scope(reviews, brand).agg(*label_counts())
    return counts.unpivot([], LABELS, "sentiment", "n")


def source_counts(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    return scope(reviews, brand).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def category_counts(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    """Sources in their categories: category order, then count."""
    rows = source_counts(reviews, brand).withColumn("source", F.coalesce("source", F.lit("web"))).groupBy("source").agg(F.sum("n").alias("n"))
    rows = rows.select(X.category(F.col("source")).alias("category"), "source", X.label(F.col("source")).alias("label"), "n")
    # one row for each source: a window over the taxonomy's few rows
    rows = rows.withColumn("category_total", F.sum("n").over(Window.partitionBy("category")))
    return rows.orderBy(X.category_rank(F.col("category")), F.desc("n"), "source")


def average_rating(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    return scope(reviews, brand).agg(F.bround(F.avg("rating"), 2).alias("avg_rating"))


def brand_blocks(reviews: DataFrame) -> DataFrame:
    """Totals, sentiment, rating and health of every brand, in one pass."""
    rows = relevant_only(reviews).groupBy("brand").agg(F.count("*").alias("total"), *label_counts(), F.bround(F.avg("rating"), 2).alias("avg_rating"))
    score = X.health_score(F.col("positive"), F.col("neutral"), F.col("negative"), F.col("avg_rating"))
    return rows.withColumn("health", score).withColumn("health_label", X.health_label(F.col("health")))


def source_share(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    """Whole percent of each source, half up, as dashboards show it."""
    rows = source_counts(reviews, brand)
    return rows.crossJoin(total(reviews, brand)).select("source", "n", F.floor(100 * F.col("n") / F.col("total") + 0.5).cast("int").alias("percent"))


def trend(reviews: DataFrame, brand: str | None = None, bucket: str = "month") -> DataFrame:
    """Labels by the month (or year) written in created_at; undated rows are left out."""
    dated = scope(reviews, brand).withColumn("_d", X.parsed_date(F.col("created_at"))).where("_d is not null")
    period = F.col("_d.year") if bucket == "year" else F.col("_d.month")
    rows = dated.groupBy(period.alias("period")).agg(*label_counts())
    return rows.withColumn("total", F.col("positive") + F.col("neutral") + F.col("negative")).orderBy("period")


def counts_and_newest(dated: DataFrame, recent: int) -> DataFrame:
    """One row (n, bad, newest) of rows (at, id, negative): how many, how many negative, and the flags of the newest.

    One pass: each task counts its rows and keeps its newest, ties by id; what tasks kept meets in two steps.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = bad = 0
        newest = None
        for batch in batches:
            n += batch.num_rows
            bad += pc.sum(batch.column("negative").cast(pa.int64())).as_py() or 0
            rows = pa.Table.from_batches([batch] if newest is None else [newest, batch])
            order = pc.sort_indices(rows, sort_keys=[("at", "descending"), ("id", "ascending")])
            newest = rows.take(order[:recent]).combine_chunks().to_batches()[0] if rows.num_rows else None
        if newest is not None:
            # the counts go with the first row
            first = pa.array([n] + [0] * (newest.num_rows - 1)), pa.array([bad] + [0] * (newest.num_rows - 1))
            yield pa.RecordBatch.from_arrays([*newest.columns, *first], [*newest.schema.names, "n", "bad"])

    # later instants first: micros are negated, so that one ascending order serves both
    rows = dated.select(F.unix_micros("at").alias("at"), "id", "negative").mapInArrow(keep, "at long, id string, negative boolean, n long, bad long")
    held = F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("at"), "id", "negative")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "bad")]
    some = rows.groupBy(F.pmod(F.xxhash64("at", "id"), F.lit(64)).alias("part")).agg(*sums, F.slice(held, 1, recent).alias("newest"))
    whole = F.slice(F.array_sort(F.flatten(F.collect_list("newest"))), 1, recent)
    return some.agg(*sums, F.transform(whole, lambda r: r["negative"]).alias("newest"))


def drop_alert(reviews: DataFrame, brand: str | None = None, recent: int = 30, more: int = 10) -> DataFrame:
    """Negative share of the newest `recent` dated reviews against all older ones, in one pass over the rows."""
    dated = scope(reviews, brand).select("id", (F.col("sentiment").eqNullSafe("negative")).alias("negative"), X.parsed_date(F.col("created_at"))["instant"].alias("at")).where("at is not null")
    both = counts_and_newest(dated, recent).withColumn("n1", F.size("newest")).withColumn("bad1", F.size(F.filter("newest", lambda x: x)))
    pct = lambda a, b: F.bround(100 * a / F.nullif(b, F.lit(0)), 0).cast("int")
    rows = both.select("n", pct(F.col("bad1"), F.col("n1")).alias("r"), F.coalesce(pct(F.col("bad") - F.col("bad1"), F.col("n") - F.col("n1")), F.lit(0)).alias("b"))
    delta = F.col("r") - F.col("b")
    enough = F.col("n") >= recent + more
    status = F.when(~enough, "insufficient").when(delta >= 15, "drop").when(delta >= 7, "watch").otherwise("ok")
    shown = lambda c, name: F.when(enough, c).alias(name)
    return rows.select(status.alias("status"), shown(F.col("r"), "recent_negative_pct"), shown(F.col("b"), "baseline_negative_pct"), shown(delta, "delta"))


def trend_volatility(reviews: DataFrame, brand: str | None = None) -> DataFrame:
    """Is the monthly trend too jumpy to read: a swing of 0.4 in positive share, or a month under five rows?"""
    months = trend(reviews, brand).where("total > 0").withColumn("share", F.col("positive") / F.col("total"))
    swing = F.abs(F.col("share") - F.lag("share").over(Window.orderBy("period")))  # one row for each month
    rows = months.withColumn("swing", swing).agg(F.round(F.coalesce(F.max("swing"), F.lit(0.0)), 6).alias("max_swing"), F.min("total").alias("least_rows"))
    return rows.withColumn("volatile", F.coalesce((F.col("max_swing") >= 0.4) | (F.col("least_rows") < 5), F.lit(False)))


def compare(reviews: DataFrame, a: str | None, b: str | None) -> DataFrame:
    """Two brands side by side, a row each; a side without a name is left out."""
    sides = None
    for side, name in (("a", a), ("b", b)):
        if not name:
            continue
        rows = scope(reviews, name)
        one = rows.agg(F.count("*").alias("total"), *label_counts(), F.bround(F.avg("rating"), 2).alias("avg_rating"))
        top = source_counts(reviews, name).limit(1).select(F.col("source").alias("top_source"))
        score = X.health_score(F.col("positive"), F.col("neutral"), F.col("negative"), F.col("avg_rating"))
        one = one.join(top, how="left").select(F.lit(side).alias("side"), F.lit(name).alias("brand"), "*", score.alias("health")).withColumn("health_label", X.health_label(F.col("health")))
        sides = one if sides is None else sides.unionByName(one)
    if sides is None:
        raise ValueError("name at least one brand")
    return sides


def verdict(reviews: DataFrame, a: str, b: str) -> DataFrame:
    """Who leads by health, positive share, rating and volume, and which side has 35 % or more negative."""
    rows = compare(reviews, a, b)
    side = lambda s: rows.where(F.col("side") == s)
    pct = lambda c: F.floor(100 * F.col(c) / F.nullif(F.col("positive") + F.col("neutral") + F.col("negative"), F.lit(0)) + 0.5).cast("int")
    facts = lambda s: side(s).select(F.col("health").alias(f"health_{s}"), pct("positive").alias(f"positive_{s}"), pct("negative").alias(f"negative_{s}"), F.col("avg_rating").alias(f"rating_{s}"), F.col("total").alias(f"total_{s}"), F.col("top_source").alias(f"top_{s}"))
    both = facts("a").crossJoin(facts("b"))  # one row each
    lead = lambda name: F.when(F.col(f"{name}_a") > F.col(f"{name}_b"), "a").when(F.col(f"{name}_a") < F.col(f"{name}_b"), "b").when(F.col(f"{name}_a") == F.col(f"{name}_b"), "tie").alias(f"{name}_lead")
    return both.select(
        F.abs(F.col("health_a") - F.col("health_b")).alias("health_gap"), *[lead(n) for n in ("health", "positive", "rating", "total")],
        "top_a", "top_b", (F.col("negative_a") >= 35).alias("warn_a"), (F.col("negative_b") >= 35).alias("warn_b"),
    )
