"""Key phrases by TF-IDF, themes by k-means, and a summary in words, over a sample of reviews.

The sample is a bounded report (60 rows by default); everything below works on any number of rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import text as X
from tidewater.functions.taxonomy import GENERIC_STOP_WORDS, STOP_WORDS

FEATURES = 500


def stop_words(brand: str | None = None) -> list[str]:
    """English stop words, words that make no topic, and the brand's own."""
    return sorted({*STOP_WORDS, *GENERIC_STOP_WORDS, *re.findall("[a-z0-9]+", (brand or "").lower())})


def terms_of(text: Column, stop: list[str]) -> Column:
    """Words and pairs of neighbours once stop words are gone."""
    words = F.filter(X.words(text), lambda w: ~w.isin(stop))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def weights(reviews: DataFrame, stop: list[str], features: int = FEATURES) -> DataFrame:
    """(id, sentiment, term, weight): sublinear TF times smooth IDF, unit length a document.

    Terms in two documents or more count (one, below six documents), the `features` most frequent of
    them; ties by term.
    """
    docs = reviews.where(X.strip(F.col("text")) != "").select("id", "sentiment", F.explode_outer(terms_of(F.col("text"), stop)).alias("term"))
    n = docs.agg(F.count_distinct("id").alias("n_docs"))
    tf = docs.where("term is not null").groupBy("id", "sentiment", "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(n)
    picked = stats.where(F.col("df") >= F.when(F.col("n_docs") >= 6, 2).otherwise(1)).orderBy(F.desc("total"), "term").limit(features)
    # at most `features` rows
    raw = tf.join(F.broadcast(picked), "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "sentiment", "term", "n_docs", (F.col("w") / norm).alias("weight"))


def top_terms(weighted: DataFrame, n: int = 5) -> DataFrame:
    """The terms with the largest mean weight, ties by term."""
    rows = weighted.groupBy("term").agg(F.round(F.sum("weight"), 6).alias("sum_weight"))
    return rows.where("sum_weight > 0").orderBy(F.desc("sum_weight"), "term").limit(n)


#: Rounds of means at most; they end earlier where no review changes its theme.
ROUNDS = 12
#: Weights as whole numbers, so that distances are exact and themes the same on every engine.
UNIT = 10_000


def theme_count(n: int, features: int) -> int:
    return max(2, min(6, n // 12 or 2, features))


def grouped(weights: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """The theme of each row of whole weights (rows in order of id).

    Starts: the first row, then again and again the row farthest from its nearest start. Then each row goes to
    the nearest mean, until none moves. Ties go to the earlier row or theme; a theme without rows is gone.
    """
    own = (weights * weights).sum(1)
    starts = [0]
    while len(starts) < k:
        apart = own[:, None] + own[starts] - 2 * weights @ weights[starts].T
        starts.append(int(apart.min(1).argmax()))
    theme = (own[starts] - 2 * weights @ weights[starts].T).argmin(1)
    for _ in range(rounds):
        count = np.bincount(theme, minlength=k)
        held = np.flatnonzero(count)
        sums = np.stack([weights[theme == j].sum(0) for j in held])
        # squared distance to a mean, without the row's own part, in thousandths
        far = 1000 * ((sums * sums).sum(1) - 2 * count[held] * (weights @ sums.T)) // count[held] ** 2
        now = held[far.argmin(1)]
        if (now == theme).all():
            break
        theme = now
    return theme


def themes(reviews: DataFrame, stop: list[str]) -> DataFrame:
    """Clusters of a sample with top term, size, majority sentiment and a sentence on them, largest first, at most six.

    k is max(2, min(6, n // 12 or 2, features)); samples under four rows or two terms have no themes. The sample
    is bounded (the limit is the feature): its rows and at most FEATURES terms are grouped in one task.
    """
    weighted = weights(reviews, stop).cache()
    rows = reviews.where(X.strip(F.col("text")) != "").select("id", "sentiment").dropDuplicates(["id"])
    whole = F.round(F.col("weight") * UNIT).cast("long")
    held = weighted.groupBy("id").agg(F.collect_list(F.struct("term", whole.alias("w"))).alias("held"))
    one = rows.join(held, "id", "left").withColumn("all", F.lit(0))

    def cluster(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("id")
        terms = [{t["term"]: t["w"] for t in row or []} for row in sample.column("held").to_pylist()]
        vocabulary = sorted({t for row in terms for t in row})
        names = sample.select(["id", "sentiment"])
        if len(terms) < 4 or len(vocabulary) < 2:
            return names.slice(0, 0).append_column("theme", pa.array([], pa.int32()))
        matrix = np.array([[row.get(t, 0) for t in vocabulary] for row in terms], np.int64)
        return names.append_column("theme", pa.array(grouped(matrix, theme_count(*matrix.shape)).astype(np.int32)))

    labelled = one.groupBy("all").applyInArrow(cluster, "id string, sentiment string, theme int")
    facts = labelled.groupBy("theme").agg(F.count("*").alias("mentions"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")])
    best = labelled.select("id", "theme").join(weighted.select("id", "term", "weight"), "id").groupBy("theme", "term").agg(F.sum("weight").alias("w"))
    first = Window.partitionBy("theme").orderBy(F.round("w", 6).desc(), "term")
    best = best.withColumn("_n", F.row_number().over(first)).where("_n <= 3").groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("_n", "term")))["term"].alias("terms"))
    tone = F.when((F.col("positive") >= F.col("neutral")) & (F.col("positive") >= F.col("negative")), "positive").when(F.col("neutral") >= F.col("negative"), "neutral").otherwise("negative")
    lead = F.element_at("terms", 1)
    said = F.concat(F.lit("About "), F.col("mentions").cast("string"), F.lit(" reviews, most often on "), F.array_join("terms", ", "), F.lit("; mostly "), tone, F.lit("."))
    named = facts.join(best, "theme").select("theme", F.concat(F.upper(F.substring(lead, 1, 1)), F.substring(lead, 2, 200)).alias("name"), "mentions", tone.alias("sentiment"), said.alias("description"))
    return named.orderBy(F.desc("mentions"), "theme").limit(6)


def named_terms(weighted: DataFrame, sentiment: str, n: int = 5) -> DataFrame:
    """One row (terms): the top terms of one sentiment in order, first letters raised."""
    rows = top_terms(weighted.where(F.col("sentiment") == sentiment), n)
    order = F.array_sort(F.collect_list(F.struct((-F.col("sum_weight")).alias("w"), "term")))
    return rows.agg(F.transform(order, lambda x: F.concat(F.upper(F.substring(x["term"], 1, 1)), F.substring(x["term"], 2, 200))).alias("terms"))


def report(reviews: DataFrame, stop: list[str]) -> DataFrame:
    """`summary` with pros and cons, the terms that tell praise and complaints; where there are both, behaviour names the first of each."""
    weighted = weights(reviews, stop)
    pros, cons = (named_terms(weighted, s).withColumnRenamed("terms", c) for s, c in (("positive", "pros"), ("negative", "cons")))
    # one row each
    rows = summary(reviews).crossJoin(pros).crossJoin(cons)
    both = F.concat(F.lit(" Praise is mostly about "), F.lower(F.get("pros", F.lit(0))), F.lit(", complaints about "), F.lower(F.get("cons", F.lit(0))), F.lit("."))
    return rows.withColumn("behavior", F.concat("behavior", F.coalesce(both, F.lit(""))))


def summary(reviews: DataFrame) -> DataFrame:
    """Numbers of the report and the sentence on behaviour."""
    rows = reviews.where(X.strip(F.col("text")) != "")
    facts = rows.agg(F.count("*").alias("reviews"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")], F.bround(F.avg("rating"), 2).alias("avg_rating"))
    pct = lambda c: F.coalesce(F.bround(100 * F.col(c) / F.nullif(F.col("reviews"), F.lit(0)), 0), F.lit(0)).cast("int")
    behavior = (
        F.when(F.col("positive") > 2 * F.col("negative"), "Praise outweighs complaints by more than two to one.")
        .when(F.col("negative") > F.col("positive"), "Complaints outnumber praise.")
        .otherwise("Praise and complaints are close to even.")
    )
    return facts.select("reviews", "positive", "neutral", "negative", "avg_rating", *[pct(c).alias(f"{c}_pct") for c in ("positive", "neutral", "negative")], behavior.alias("behavior"))
