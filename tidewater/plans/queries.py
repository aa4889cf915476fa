"""Every operator as a registered query, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions import valence
from tidewater.functions.schema import RAW_SCHEMA, SERVED_SCHEMA
from tidewater.functions.taxonomy import GENERIC_BRAND_WORDS, HOSTS, OTHER, SOURCES, TRUSTED
from tidewater.operators import alerts, enrich, insights, meaning, report, retrieve, store, tables, vectors
from tidewater.operators import reviews as R
from tidewater.operators.scratch import shared_folder
from tidewater.plans.fixtures import REVIEWS_SQL, reviews, table
from tidewater.sources import html, mappers, staging
from tidewater.streaming import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, base: bool = True):
    """Register a function; sql follows the review rows unless base is False."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            text = sql.strip()
            ORACLE[key] = text if not base else f"WITH {REVIEWS_SQL}{', ' + text[5:] if text.startswith('WITH ') else text}"
        return f

    return add


BRAND = "Brand#3"
RELEVANT = "relevant IS NOT FALSE"
IN = f"brand ILIKE '{BRAND}' AND {RELEVANT}"


def lit_sql(rows: list[tuple], columns: list[str]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS t({', '.join(columns)})"


# ---- values drawn for each document: odd ones come up beside the document's own words and number


def drawn(spark, d: str, values: list, kind: str = "string") -> DataFrame:
    """doc_id and, as `v`, one of the values for each document, with @n as its number and @t as its text inside JSON."""
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))).alias("j"))
    value = F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    if kind == "string":
        value = F.replace(F.replace(value, F.lit("@n"), F.col("doc_id").cast("string")), F.lit("@t"), F.expr("substring(j, 7, length(j) - 8)"))
    return docs.select("doc_id", value.alias("v"))


def drawn_sql(values: list, kind: str = "VARCHAR") -> str:
    quote = lambda v: "NULL" if v is None else str(v) if kind != "VARCHAR" else "'" + v.replace("'", "''") + "'"
    value = f"CAST([{', '.join(map(quote, values))}] AS {kind}[])[doc_id % {len(values)} + 1]"
    if kind == "VARCHAR":
        value = f"replace(replace({value}, '@n', CAST(doc_id AS VARCHAR)), '@t', substring(j, 2, length(j) - 2))"
    return f"(SELECT doc_id, {value} AS v FROM (SELECT doc_id, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS j FROM documents))"


# ---- counts


@query(f"SELECT count(*) AS total FROM reviews WHERE {IN}")
def stats_total(spark, d):
    return R.total(reviews(spark, d), BRAND)


@query(f"SELECT count(*) FILTER (relevant = false) AS flagged FROM reviews WHERE brand ILIKE '{BRAND}'")
def stats_flagged(spark, d):
    return R.flagged(reviews(spark, d), BRAND)


@query(f"""SELECT s.sentiment, count(r.id) AS n FROM (VALUES ('positive'), ('neutral'), ('negative')) s(sentiment)
    LEFT JOIN (SELECT * FROM reviews WHERE {RELEVANT}) r ON r.sentiment = s.sentiment GROUP BY s.sentiment""")
def stats_sentiment(spark, d):
    return R.sentiment_counts(reviews(spark, d))


@query(f"SELECT source, count(*) AS n FROM reviews WHERE {RELEVANT} GROUP BY source")
def stats_by_source(spark, d):
    return R.source_counts(reviews(spark, d))


_TAXONOMY = lit_sql(SOURCES, ["source", "category", "label"]).replace(" AS t(", " AS x(")


@query(f"""WITH n AS (SELECT coalesce(source, 'web') AS source, count(*) AS n FROM reviews WHERE {RELEVANT} GROUP BY 1)
    SELECT coalesce(x.category, '{OTHER}') AS category, n.source, coalesce(x.label, n.source) AS label, n.n, CAST(sum(n.n) OVER (PARTITION BY coalesce(x.category, '{OTHER}')) AS BIGINT) AS category_total
    FROM n LEFT JOIN {_TAXONOMY} USING (source)""")
def stats_by_category(spark, d):
    return R.category_counts(reviews(spark, d))


@query(f"SELECT round_even(avg(rating), 2) AS avg_rating FROM reviews WHERE {RELEVANT}")
def stats_avg_rating(spark, d):
    return R.average_rating(reviews(spark, d))


_BLOCK = """count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral,
    count(*) FILTER (sentiment = 'negative') AS negative, round_even(avg(rating), 2) AS avg_rating"""
_SCORE = """CAST(round_even(CASE WHEN avg_rating IS NULL THEN 100 * (positive + 0.5::DOUBLE * neutral) / nullif(positive + neutral + negative, 0)
    ELSE 0.6::DOUBLE * (100 * (positive + 0.5::DOUBLE * neutral) / nullif(positive + neutral + negative, 0)) + 0.4::DOUBLE * (100 * avg_rating / 5) END, 0) AS INTEGER)"""
_GRADE = "CASE WHEN health IS NULL THEN 'No data' WHEN health >= 80 THEN 'Excellent' WHEN health >= 65 THEN 'Good' WHEN health >= 45 THEN 'Mixed' ELSE 'At risk' END AS health_label"


@query(f"""WITH b AS (SELECT brand, {_BLOCK} FROM reviews WHERE {RELEVANT} GROUP BY brand), s AS (SELECT *, {_SCORE} AS health FROM b) SELECT *, {_GRADE} FROM s""")
def brand_block(spark, d):
    return R.brand_blocks(reviews(spark, d))


_AVERAGES = [None, 5.0, 2.5, 3.15, 1.0, 4.995]


@query(f"""WITH c AS (SELECT doc_id, v AS avg_rating FROM {drawn_sql(_AVERAGES, "DOUBLE")}), b AS (SELECT doc_id, avg_rating, doc_id % 11 AS positive, doc_id // 11 % 7 AS neutral, doc_id // 77 % 9 AS negative FROM c), s AS (SELECT *, {_SCORE} AS health FROM b) SELECT *, {_GRADE} FROM s""", base=False)
def health_score(spark, d):
    n = F.col("doc_id")
    rows = drawn(spark, d, _AVERAGES, "double").select("doc_id", F.col("v").alias("avg_rating"), (n % 11).alias("positive"), (F.floor(n / 11) % 7).alias("neutral"), (F.floor(n / 77) % 9).alias("negative"))
    rows = rows.withColumn("health", X.health_score(*[F.col(c) for c in ("positive", "neutral", "negative", "avg_rating")]))
    return rows.withColumn("health_label", X.health_label(F.col("health")))


@query(f"""WITH n AS (SELECT source, count(*) AS n FROM reviews WHERE {RELEVANT} GROUP BY source)
    SELECT source, n, CAST(floor(100 * n / (SELECT sum(n) FROM n) + 0.5) AS INTEGER) AS percent FROM n""")
def source_share(spark, d):
    return R.source_share(reviews(spark, d))


def _trend(cut: int, where: str = RELEVANT) -> str:
    return f"""SELECT substring(created_at, 1, {cut}) AS period, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral,
        count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment IN ('positive', 'neutral', 'negative')) AS total
        FROM reviews WHERE {where} AND created_at IS NOT NULL GROUP BY 1"""


@query(_trend(7))
def trend_month(spark, d):
    return R.trend(reviews(spark, d))


@query(_trend(4))
def trend_year(spark, d):
    return R.trend(reviews(spark, d), bucket="year")


def _alert(where: str) -> str:
    return f"""WITH o AS (SELECT sentiment, row_number() OVER (ORDER BY created_at DESC, id) AS k FROM reviews WHERE {where} AND created_at IS NOT NULL),
        c AS (SELECT count(*) AS n, CAST(round_even(100.0::DOUBLE * count(*) FILTER (k <= 30 AND sentiment = 'negative') / nullif(count(*) FILTER (k <= 30), 0), 0) AS INTEGER) AS r,
            coalesce(CAST(round_even(100.0::DOUBLE * count(*) FILTER (k > 30 AND sentiment = 'negative') / nullif(count(*) FILTER (k > 30), 0), 0) AS INTEGER), 0) AS b FROM o)
        SELECT CASE WHEN n < 40 THEN 'insufficient' WHEN r - b >= 15 THEN 'drop' WHEN r - b >= 7 THEN 'watch' ELSE 'ok' END AS status,
            CASE WHEN n >= 40 THEN r END AS recent_negative_pct, CASE WHEN n >= 40 THEN b END AS baseline_negative_pct, CASE WHEN n >= 40 THEN r - b END AS delta FROM c"""


@query(_alert(RELEVANT))
def sentiment_alert(spark, d):
    return R.drop_alert(reviews(spark, d))


@query(_alert(IN))
def sentiment_alert_brand(spark, d):
    return R.drop_alert(reviews(spark, d), BRAND)


@query(f"""WITH m AS ({_trend(7)}), s AS (SELECT *, positive::DOUBLE / total AS share FROM m WHERE total > 0), w AS (SELECT *, abs(share - lag(share) OVER (ORDER BY period)) AS swing FROM s),
    f AS (SELECT round(coalesce(max(swing), 0), 6) AS max_swing, min(total) AS least_rows FROM w) SELECT *, coalesce(max_swing >= 0.4 OR least_rows < 5, false) AS volatile FROM f""")
def trend_volatility(spark, d):
    return R.trend_volatility(reviews(spark, d))


OTHER_BRAND = "Brand#8"


def _side(side: str, brand: str) -> str:
    where = f"brand ILIKE '{brand}' AND {RELEVANT}"
    return f"""SELECT '{side}' AS side, '{brand}' AS brand, {_BLOCK}, (SELECT source FROM reviews WHERE {where} GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS top_source FROM reviews WHERE {where}"""


_SIDES = f"WITH p AS ({_side('a', BRAND)} UNION ALL {_side('b', OTHER_BRAND)}), q AS (SELECT *, {_SCORE} AS health FROM p)"


@query(f"{_SIDES} SELECT *, {_GRADE} FROM q")
def compare_brands(spark, d):
    return R.compare(reviews(spark, d), BRAND, OTHER_BRAND)


def _lead(name: str) -> str:
    return f"CASE WHEN a.{name} > b.{name} THEN 'a' WHEN a.{name} < b.{name} THEN 'b' WHEN a.{name} = b.{name} THEN 'tie' END AS {name}_lead"


@query(f"""{_SIDES}, v AS (SELECT side, health, avg_rating AS rating, total, top_source, CAST(floor(100 * positive / nullif(positive + neutral + negative, 0) + 0.5) AS INTEGER) AS positive, CAST(floor(100 * negative / nullif(positive + neutral + negative, 0) + 0.5) AS INTEGER) AS negative FROM q)
    SELECT abs(a.health - b.health) AS health_gap, {_lead("health")}, {_lead("positive")}, {_lead("rating")}, {_lead("total")}, a.top_source AS top_a, b.top_source AS top_b, a.negative >= 35 AS warn_a, b.negative >= 35 AS warn_b
    FROM v a, v b WHERE a.side = 'a' AND b.side = 'b'""")
def compare_verdict(spark, d):
    return R.verdict(reviews(spark, d), BRAND, OTHER_BRAND)


# ---- filters, lists and samples


@query("SELECT id, brand FROM reviews WHERE brand ILIKE 'brand#1_'")
def filter_brand(spark, d):
    return R.of_brand(reviews(spark, d), "brand#1_").select("id", "brand")


@query(f"SELECT id, relevant FROM reviews WHERE {RELEVANT}")
def filter_relevant(spark, d):
    return R.relevant_only(reviews(spark, d)).select("id", "relevant")


_EXCERPT = "CASE WHEN length(text) > {n} THEN substring(text, 1, {n}) || '{suffix}' ELSE text END"
_LISTED = f"id, brand, source, source_url, author, rating, sentiment, {_EXCERPT.format(n=240, suffix='…')} AS excerpt, captured_at"
_NEWEST = "captured_at DESC NULLS FIRST, id"
_HOST = "split_part(split_part(source_url, '://', 2), '/', 1)"
_NEG = "CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END"
_SORTS = {
    "recent": _NEWEST,
    "oldest": "captured_at ASC NULLS LAST, id",
    "rating_high": f"rating DESC NULLS LAST, {_NEWEST}",
    "rating_low": f"rating ASC NULLS LAST, {_NEWEST}",
    "negative": f"{_NEG}, {_NEWEST}",
    "positive": f"CASE sentiment WHEN 'positive' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END, {_NEWEST}",
    "platform": f"source ASC NULLS LAST, {_HOST} ASC NULLS LAST, {_NEG}, {_NEWEST}",
}


def _list(sort: str) -> None:
    @query(f"SELECT {_LISTED} FROM reviews WHERE {RELEVANT} ORDER BY {_SORTS[sort]} LIMIT 40", f"reviews_{sort}")
    def run(spark, d):
        return R.listed(reviews(spark, d), sort=sort)


for _s in _SORTS:
    _list(_s)


@query(f"SELECT {_LISTED} FROM reviews WHERE {RELEVANT} AND source = 'yelp' ORDER BY {_NEWEST} LIMIT 200")
def reviews_by_source(spark, d):
    return R.listed(reviews(spark, d), source="yelp", limit=1000)


@query(f"SELECT id, source, source_url, rating, {_EXCERPT.format(n=240, suffix='…')} AS excerpt FROM reviews WHERE {RELEVANT} AND sentiment = 'negative' ORDER BY {_NEWEST} LIMIT 12")
def recent_negative(spark, d):
    return R.recent_negative(reviews(spark, d))


@query(f"SELECT id, source, rating, sentiment FROM reviews WHERE brand ILIKE '{BRAND}' AND text IS NOT NULL ORDER BY {_NEWEST} LIMIT 60")
def insights_sample(spark, d):
    return R.sample(reviews(spark, d), BRAND).select("id", "source", "rating", "sentiment")


_EVIDENCE = f"""WITH e AS (SELECT CAST(row_number() OVER o AS INTEGER) AS n, id, source, source_url, rating, sentiment, {_EXCERPT.format(n=220, suffix="...")} AS excerpt FROM reviews WHERE brand ILIKE '{BRAND}' AND text IS NOT NULL
    WINDOW o AS (ORDER BY CASE sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 ELSE 2 END, {_NEWEST}) QUALIFY n <= 24)"""


@query(f"{_EVIDENCE} SELECT * FROM e")
def report_sample(spark, d):
    return R.balanced_sample(reviews(spark, d), BRAND)


@query(f"{_EVIDENCE} SELECT * FROM e")
def report_sources_platform(spark, d):
    return R.by_platform(R.balanced_sample(reviews(spark, d), BRAND))


@query(f"""SELECT {", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ("brand", "source", "source_url", "author", "rating", "sentiment", "text", "created_at", "captured_at"))}
    FROM (SELECT * FROM reviews WHERE brand ILIKE '{BRAND}' ORDER BY {_NEWEST} LIMIT 5000)""")
def export_reviews(spark, d):
    return R.export_rows(reviews(spark, d), BRAND)


@query(f"WITH b AS (SELECT {_BLOCK} FROM reviews WHERE {IN}), s AS (SELECT *, {_SCORE} AS health FROM b) SELECT *, {_GRADE} FROM s")
def report_facts(spark, d):
    return report.facts(reviews(spark, d), BRAND)


# ---- scalar rules on literal rows

_URLS = ["https://www.reddit.com/r/x", "https://notreddit.com.evil.com/", "https://netflix.com/", "https://reddit.com:443/x", "", None, "https://youtu.be/abc", "x.com/post", "HTTPS://M.FACEBOOK.COM/a", "http://a.com/?u=https://x.com/b", "https://news.ycombinator.com/item?id=1", "www.amadeus.com/fr", "https://www.threads.net/@a", "https://www.shop@n.example/x"]
_H = "split_part(list_extract(string_split(lower(coalesce(u, '')), '://'), -1), '/', 1)"
_TAG = "CASE " + " ".join(f"WHEN {_H} = '{h}' OR ends_with({_H}, '.{h}') THEN '{s}'" for h, s in HOSTS) + " ELSE 'web' END"


@query(f"SELECT u, {_TAG} AS source FROM {lit_sql([(u,) for u in _URLS], ['u'])} UNION ALL SELECT url, {_TAG.replace('coalesce(u,', 'coalesce(url,')} FROM pages", base=False)
def host_source(spark, d):
    urls = spark.createDataFrame([(u,) for u in _URLS], "u string").unionAll(table(spark, d, "pages").select("url"))
    return urls.select("u", X.source_from_url(F.col("u")).alias("source"))


@query(f"WITH p AS (SELECT url AS u FROM pages UNION ALL SELECT v FROM {drawn_sql(_URLS)}) SELECT u, nullif(CASE WHEN starts_with({_H}, 'www.') THEN substring({_H}, 5) ELSE {_H} END, '') AS domain FROM p", base=False)
def bare_domain(spark, d):
    urls = table(spark, d, "pages").select(F.col("url").alias("u")).unionAll(drawn(spark, d, _URLS).select("v"))
    return urls.select("u", X.bare_domain(F.col("u")).alias("domain"))


_NAMED = ["blog", None, "", "Reddit", *[s for s, _, _ in SOURCES]]


@query(f"WITH n AS (SELECT source FROM reviews UNION ALL SELECT v FROM {drawn_sql(_NAMED)}) SELECT n.source, coalesce(x.category, '{OTHER}') AS category, coalesce(x.label, n.source) AS label FROM n LEFT JOIN {_TAXONOMY} ON n.source = x.source")
def source_category(spark, d):
    named = reviews(spark, d).select("source").unionAll(drawn(spark, d, _NAMED).select("v"))
    return named.select("source", X.category(F.col("source")).alias("category"), X.label(F.col("source")).alias("label"))


@query(f"SELECT id, {_EXCERPT.format(n=240, suffix='…')} AS listed, {_EXCERPT.format(n=280, suffix='…')} AS cited, {_EXCERPT.format(n=220, suffix='...')} AS reported FROM reviews")
def excerpts(spark, d):
    t = F.col("text")
    return reviews(spark, d).select("id", X.excerpt(t, 240, "…").alias("listed"), X.excerpt(t, 280, "…").alias("cited"), X.excerpt(t, 220, "...").alias("reported"))


_RATINGS = ["5", "4.5", "", "n/a", "0", None, " 3 ", "-1e1", "@n", "@n.5", "@n stars", "1e@n", "0x@n"]


@query(f"SELECT doc_id, v, TRY_CAST(trim(v) AS DOUBLE) AS rating FROM {drawn_sql(_RATINGS)}", base=False)
def safe_rating(spark, d):
    return drawn(spark, d, _RATINGS).select("doc_id", "v", X.to_rating(F.col("v")).alias("rating"))


_STARS = [3.5, 3.49, 2.5, 2.51, 0.0, 5.0, None]


@query(f"WITH r AS (SELECT doc_id, rating AS r FROM reviews UNION ALL SELECT doc_id, v FROM {drawn_sql(_STARS, 'DOUBLE')}) SELECT doc_id, r, CASE WHEN r >= 3.5 THEN 'positive' WHEN r <= 2.5 THEN 'negative' WHEN r IS NOT NULL THEN 'neutral' END AS sentiment FROM r")
def sentiment_stars(spark, d):
    stars = reviews(spark, d).select("doc_id", F.col("rating").alias("r")).unionAll(drawn(spark, d, _STARS, "double"))
    return stars.select("doc_id", "r", X.star_sentiment(F.col("r")).alias("sentiment"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_LEXICON = valence.own_lexicon()


def _names(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


def felt_sql(source: str, lexicon: str | None = None) -> str:
    """Common table expressions up to `felt` (key, x), the summed valence of the rows (key, text) of a source."""
    words = lexicon or "(VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in _LEXICON.items()) + ")"
    degrees = {w: s for w, s in valence.DEGREES.items() if lexicon or w not in _LEXICON}
    degree = lambda p: f"CASE WHEN {p} IN {_names(w for w, s in degrees.items() if s > 0)} THEN 1 WHEN {p} IN {_names(w for w, s in degrees.items() if s < 0)} THEN -1 ELSE 0 END"
    capital = "word = upper(word) AND word <> lower(word)"
    near = " ".join(f"+ sign(v) * ({degree(f'p{k}')}) * {valence.DEGREE}::DOUBLE * {f}::DOUBLE" for k, f in enumerate(valence.FADE, 1))
    negated = " OR ".join(f"coalesce(p{k} IN {_names(valence.NEGATIONS)}, false)" for k in (1, 2, 3))
    marks = f"(least(length(text) - length(replace(text, '!', '')), {valence.MOST_EXCLAIM}) * {valence.EXCLAIM}::DOUBLE + CASE WHEN q < 2 THEN 0 WHEN q <= 3 THEN {valence.ASK}::DOUBLE * q ELSE {valence.MANY_ASK}::DOUBLE END)"
    return rf"""src AS (SELECT key, coalesce(text, '') AS text FROM {source}),
        heard AS (SELECT key, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT key, regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+') AS w FROM src)),
        around AS (SELECT key, i, word, lower(word) AS low, lag(lower(word), 1) OVER o AS p1, lag(lower(word), 2) OVER o AS p2, lag(lower(word), 3) OVER o AS p3,
            min(CASE WHEN lower(word) = 'but' THEN i END) OVER (PARTITION BY key) AS but_at, count(*) FILTER ({capital}) OVER (PARTITION BY key) AS capitals, count(*) OVER (PARTITION BY key) AS n
            FROM heard WINDOW o AS (PARTITION BY key ORDER BY i)),
        weighed AS (SELECT key, i, (v + CASE WHEN capitals > 0 AND capitals < n AND {capital} THEN sign(v) * {valence.STRESS}::DOUBLE ELSE 0 END {near})
            * CASE WHEN {negated} THEN {valence.TURN}::DOUBLE ELSE 1 END * CASE WHEN but_at IS NULL OR i = but_at THEN 1 WHEN i < but_at THEN {valence.BEFORE_BUT}::DOUBLE ELSE {valence.AFTER_BUT}::DOUBLE END AS w
            FROM around JOIN {words} AS lexicon(low, v) USING (low)),
        summed AS (SELECT key, sum(w ORDER BY i) AS x FROM weighed GROUP BY key),
        felt AS (SELECT key, CASE WHEN x > 0 THEN x + {marks} WHEN x < 0 THEN x - {marks} ELSE 0.0::DOUBLE END AS x FROM (SELECT key, text, coalesce(x, 0.0::DOUBLE) AS x, length(text) - length(replace(text, '?', '')) AS q FROM src LEFT JOIN summed USING (key)))"""


_COMPOUND = "x / sqrt(x * x + 15)"
_FELT = f"CASE WHEN {_COMPOUND} > 0.3 THEN 'positive' WHEN {_COMPOUND} < -0.3 THEN 'negative' ELSE 'neutral' END"


@query(f"WITH {felt_sql('(SELECT doc_id AS key, text FROM documents)')} SELECT key AS doc_id, round({_COMPOUND}, 6) AS compound, {_FELT} AS sentiment FROM felt", base=False)
def sentiment_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", valence.compound(F.col("text")).alias("c"))
    return rows.select("doc_id", F.round("c", 6).alias("compound"), F.when(F.col("c") > 0.3, "positive").when(F.col("c") < -0.3, "negative").otherwise("neutral").alias("sentiment"))


#: Openings that call for each rule, before a document's own words.
_OPENINGS = [
    "good ", "not good ", "very good ", "VERY GOOD ", "good but slow, ", "never really very good!! ", "GREAT GOOD", "isn't it awful?? ", "hardly helpful!!!!!! ", "great? bad? really???? ", "the food was lovely, but service was so so so rude. ",
    "LOVED every bit of it ", "bad very bad, nothing good ", "", "don't hate it but don't love it ", "extremely quite very sad ",
]


@query(f"WITH opened AS (SELECT o.doc_id AS key, v || coalesce(text, '') AS text FROM {drawn_sql(_OPENINGS)} o JOIN documents d ON d.doc_id = o.doc_id), {felt_sql('opened')} SELECT key AS doc_id, round({_COMPOUND}, 6) AS compound FROM felt", base=False)
def sentiment_rules(spark, d):
    rows = drawn(spark, d, _OPENINGS).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.round(valence.compound(F.concat("v", F.coalesce("text", F.lit("")))), 6).alias("compound"))


_LEARNED = r"""m AS (SELECT doc_id, min(1 - toxic) AS good FROM labels WHERE toxic IN (0, 1) GROUP BY doc_id HAVING min(toxic) = max(toxic)), r AS (SELECT DISTINCT doc_id, text FROM documents),
    u AS (SELECT good, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_'']+'))) AS word FROM r JOIN m USING (doc_id)), s AS (SELECT sum(good) AS goods, count(*) AS every FROM r JOIN m USING (doc_id)),
    c AS (SELECT word, sum(good) AS g, count(*) AS n FROM u GROUP BY word HAVING count(*) >= 5),
    learned AS (SELECT word, round(greatest(-4, least(4, ln((g + 0.5::DOUBLE) / (goods - g + 0.5::DOUBLE)) - ln((n - g + 0.5::DOUBLE) / (every - goods - n + g + 0.5::DOUBLE)))), 6) AS valence, n FROM c, s)"""


def _learn(spark, d) -> DataFrame:
    return valence.learn(table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", (1 - F.col("toxic")).alias("good")))


@query(f"WITH {_LEARNED} SELECT * FROM learned", base=False)
def lexicon_learned(spark, d):
    return _learn(spark, d)


@query(f"WITH {_LEARNED}, {felt_sql('(SELECT doc_id AS key, text FROM documents)', '(SELECT word, valence FROM learned WHERE abs(valence) >= 2)')} SELECT key AS doc_id, round({_COMPOUND}, 5) AS compound FROM felt", base=False)
def sentiment_learned(spark, d):
    """Sentiment by a lexicon that is a table, learnt from marks."""
    words = valence.read_lexicon(_learn(spark, d).where("abs(valence) >= 2"))
    return table(spark, d, "documents").select("doc_id", F.round(valence.compound(F.col("text"), words), 5).alias("compound"))


@query(r"SELECT id, substring(CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN ' ' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END, 1, 8000) AS prepared FROM reviews")
def embed_prep(spark, d):
    return reviews(spark, d).select("id", X.embed_text(F.col("text")).alias("prepared"))


_DATES = ["2024-01-31T23:30:00-05:00", "2024-01-31T23:30:00Z", "2024-01-31", "20240131", "2024", "6 years ago", "", None, "2024-02-30", "2024-03-01 10:11", "2024-03-01T10:11:12.345678+02:00", " 2024-05-05 ", "2024-01", "2024-13-01"]
_DATE = r"'^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$'"


@query(rf"""WITH p AS (SELECT raw, trim(raw) AS x FROM (SELECT CAST(o_orderdate AS VARCHAR) AS raw FROM orders UNION ALL SELECT v FROM {drawn_sql(_DATES)})), g AS (SELECT raw, x, regexp_matches(x, {_DATE}) AS ok, [{", ".join(f"regexp_extract(x, {_DATE}, {k})" for k in range(1, 9))}] AS g FROM p),
    h AS (SELECT raw, ok, g[1] || '-' || g[2] || '-' || g[3] AS day, coalesce(nullif(g[4], ''), '00') || ':' || coalesce(nullif(g[5], ''), '00') || ':' || coalesce(nullif(g[6], ''), '00') AS clock,
        CASE WHEN g[8] IN ('', 'Z') THEN '+00:00' ELSE g[8] END AS off FROM g),
    i AS (SELECT raw, CASE WHEN ok THEN TRY_CAST(day || ' ' || clock || off AS TIMESTAMPTZ) END AS instant, day FROM h)
    SELECT raw, CASE WHEN instant IS NOT NULL THEN substring(day, 1, 7) END AS month, CASE WHEN instant IS NOT NULL THEN substring(day, 1, 4) END AS year, CAST(epoch(instant) AS BIGINT) AS seconds FROM i""", base=False)
def parse_dates(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderdate").cast("string").alias("raw")).unionAll(drawn(spark, d, _DATES).select("v"))
    rows = raw.withColumn("d", X.parsed_date(F.col("raw")))
    return rows.select("raw", "d.month", "d.year", F.unix_timestamp("d.instant").alias("seconds"))


_QUESTIONS = [("How is Blue Bottle doing?", "Blue Bottle Coffee"), ("is coffee good", "Blue Bottle Coffee"), ("compare Peets and Acme", "Acme Inc"), ("anything on ACME-Inc?", "Acme Inc"), ("the group", "The Group"), ("", "Acme"), ("what of brand 3", "Brand#3"), (None, "X"), ("is brand @n better than @t", "Brand#@n"), ("@t", "In")]
_FLAT = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT question, brand, ' ' || {_FLAT.format("question")} || ' ' AS q, {_FLAT.format("brand")} AS f,
        array_to_string(list_filter(regexp_extract_all(lower(coalesce(brand, '')), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({", ".join(f"'{w}'" for w in GENERIC_BRAND_WORDS)})), ' ') AS k
        FROM (SELECT q.v AS question, b.v AS brand FROM {drawn_sql([q for q, _ in _QUESTIONS])} q JOIN {drawn_sql([b for _, b in _QUESTIONS])} b USING (doc_id)))
    SELECT question, brand, (k <> '' AND contains(q, k)) OR (f <> '' AND contains(q, f)) AS named FROM k""", base=False)
def brand_mentions(spark, d):
    asked, named = (drawn(spark, d, [pair[k] for pair in _QUESTIONS]).withColumnRenamed("v", ("question", "brand")[k]) for k in (0, 1))
    rows = asked.join(named, "doc_id")
    return rows.select("question", "brand", X.mentions(F.col("question"), F.col("brand")).alias("named"))


# ---- payloads and mappers on literal rows, the same JSON text in both engines

_STAGED = [
    '{"_airbyte_data": "{\\"text\\": \\"good @n\\", \\"url\\": \\"u1\\"}", "x": 1}',
    '{"_airbyte_data": {"text": "fine @t", "url": "u2"}}',
    '{"_airbyte_data": "{bad", "item": {"text": "nested @t", "url": "u3"}}',
    '{"data": {}, "record": {"text": "rec @n", "url": "u4"}}',
    '{"text": "plain @t", "url": "u@n"}',
]


_PAYLOAD_SQL = f"""SELECT doc_id, json_extract_string(p, '$.text') AS text, json_extract_string(p, '$.url') AS url FROM (SELECT doc_id, coalesce({", ".join(f"CASE WHEN json_valid(json_extract_string(v, '$.{k}')) AND starts_with(ltrim(json_extract_string(v, '$.{k}')), '{{') AND json_extract_string(v, '$.{k}') <> '{{}}' THEN json_extract_string(v, '$.{k}') END" for k in [staging.LEGACY, *staging.NESTED])}, v) AS p FROM {drawn_sql(_STAGED)})"""


@query(_PAYLOAD_SQL, base=False)
def unwrap_payload(spark, d):
    rows = drawn(spark, d, _STAGED).select("doc_id", staging.payload(F.col("v")).alias("item"))
    return rows.select("doc_id", mappers.field("text").alias("text"), mappers.field("url").alias("url"))


_ITEMS = {
    "google_maps": ['{"text": "Great beans @t Great beans", "reviewUrl": "https://maps/r1@n", "stars": 5, "name": "Ana", "publishedAtDate": "2024-01-02", "title": "Cafe @t Cafe"}', '{"text": "", "reviewText": "Slow @t Slow", "url": "https://maps/r2@n", "stars": 0, "rating": 2, "reviewerName": "Bo", "publishAt": "2 weeks ago", "title": "", "placeName": "Bar"}', '{"stars": 4, "url": "u"}', '{"text": "no link @t no link"}'],
    "yelp": ['{"text": "ok @t ok", "url": "https://y/1@n", "rating": 4, "userName": "C", "date": "2024-02-02", "bizName": "Biz"}', '{"comment": "meh @t meh", "reviewUrl": "https://y/2@n", "stars": "2.5", "author": "D"}', '{"text": "   ", "url": "https://y/3@n"}'],
    "tripadvisor": ['{"text": "view @t view", "url": "https://t/1@n", "rating": "4", "user": {"username": "E"}, "publishedDate": "2023-03-03", "placeName": "Inn"}', '{"review": "loud @t loud", "url": "https://t/2@n", "userName": "F"}', '{"text": "gone @t gone"}'],
    "reddit": ['{"title": "T @t T", "body": "B @t B", "url": "https://r/1@n", "username": "g", "createdAt": "2024-04-04", "communityName": "r/a", "upVotes": 7, "numberOfComments": 2, "dataType": "post"}', '{"text": "only @t only", "link": "https://r/2@n", "author": "h", "parsedCommunityName": "b"}', '{"title": "lone @t lone", "url": "https://r/3@n"}', '{"body": "x @t x"}'],
    "instagram": ['{"caption": "pic @t pic", "url": "https://i/1@n", "ownerUsername": "k", "timestamp": "2024-05-05", "likesCount": 3, "commentsCount": 0, "hashtag": "x", "type": "Image"}', '{"text": "txt @t txt", "postUrl": "https://i/2@n", "ownerFullName": "L", "takenAtDate": "2024-05-06", "inputUrl": "https://i/tag"}', '{"caption": "x @t x"}'],
    "facebook": ['{"text": "p @t p", "url": "https://f/1@n", "authorName": "M", "time": "2024-06-06", "likes": 1, "comments": 2, "shares": 3}', '{"message": "q @t q", "postUrl": "https://f/2@n", "user": {"name": "N"}, "date": "2024-06-07"}', '{"postText": "r @t r", "topLevelUrl": "https://f/3@n", "timestamp": "2024-06-08", "pageName": "O"}', '{"text": "s @t s"}'],
    "web": ['{"organicResults": [{"url": "https://www.reddit.com/r/x@n", "title": " A @t A ", "description": "d1 @t d1", "websiteTitle": "Reddit", "averageRating": 4.5, "position": 1, "displayedUrl": "reddit.com", "numberOfReviews": 8, "lastUpdated": "2024-07-01"}, {"url": "https://blog.example/@n", "title": "B @t B", "description": ""}, {"title": "no url @t no url"}]}', '{"url": "https://youtu.be/1@n", "title": "V @t V", "description": "w @t w", "date": "2024-07-07"}'],
    "normalized": ['{"text": "a @t a", "source_url": "https://n/1@n", "author": "P", "rating": 3, "created_at": "2024-08-08", "lang": "en"}', '{"review": "b @t b", "link": "https://n/2@n", "name": "Q", "stars": "5", "date": "2024-08-09"}', '{"description": "c @t c", "reviewUrl": "https://n/3@n"}', '{"text": "d @t d"}'],
}


def _any(*keys: str) -> str:
    truthy = lambda k: f"CASE WHEN json_extract_string(item, '$.{k}') NOT IN ('', 'false', '[]', '{{}}') AND coalesce(TRY_CAST(json_extract_string(item, '$.{k}') AS DOUBLE), 1) <> 0 THEN json_extract_string(item, '$.{k}') END"
    return "coalesce(" + ", ".join([*map(truthy, keys[:-1]), f"json_extract_string(item, '$.{keys[-1]}')"]) + ")"


def _one(key: str) -> str:
    return f"json_extract_string(item, '$.{key}')"


_JOINED = f"concat_ws(chr(10) || chr(10), nullif({_one('title')}, ''), nullif({_any('body', 'text')}, ''))"
_MAPS = {
    "google_maps": ("'google_maps'", _any("reviewUrl", "url"), _any("text", "reviewText"), _any("name", "reviewerName"), _any("stars", "rating"), _any("publishedAtDate", "publishAt")),
    "yelp": ("'yelp'", _any("url", "reviewUrl"), _any("text", "comment"), _any("userName", "author"), _any("rating", "stars"), _one("date")),
    "tripadvisor": ("'tripadvisor'", _one("url"), _any("text", "review"), f"CASE WHEN json_type(item, '$.user') = 'OBJECT' THEN {_one('user.username')} ELSE {_one('userName')} END", _one("rating"), _one("publishedDate")),
    "reddit": ("'reddit'", _any("url", "link"), _JOINED, _any("username", "author"), "NULL", _one("createdAt")),
    "instagram": ("'instagram'", _any("url", "postUrl"), _any("caption", "text"), _any("ownerUsername", "ownerFullName"), "NULL", _any("timestamp", "takenAtDate")),
    "facebook": ("'facebook'", _any("url", "postUrl", "topLevelUrl"), _any("text", "message", "postText"), f"coalesce(nullif({_any('authorName', 'pageName')}, ''), CASE WHEN json_type(item, '$.user') = 'OBJECT' THEN {_one('user.name')} END)", "NULL", _any("time", "date", "timestamp")),
    "web": (_TAG.replace("coalesce(u,", f"coalesce({_one('url')},"), _one("url"), f"trim(trim(coalesce({_one('title')}, '')) || CASE WHEN trim(coalesce({_one('description')}, '')) <> '' THEN chr(10) || chr(10) || trim({_one('description')}) ELSE '' END)", _one("websiteTitle"), _one("averageRating"), _one("date")),
    "normalized": ("'partner'", _any("source_url", "url", "reviewUrl", "link"), _any("text", "review", "body", "description"), _any("author", "name", "userName"), _any("rating", "stars"), _any("created_at", "createdAt", "date")),
}


#: SQL of the fields that go to `extra`.
_EXTRAS = {
    "google_maps": {"place": _any("title", "placeName")},
    "yelp": {"business": _one("bizName")},
    "tripadvisor": {"place": _one("placeName")},
    "reddit": {"subreddit": _any("communityName", "parsedCommunityName"), "up_votes": _one("upVotes"), "num_comments": _one("numberOfComments"), "data_type": _one("dataType")},
    "instagram": {"likes": _one("likesCount"), "comments": _one("commentsCount"), "hashtag": _any("hashtag", "inputUrl"), "type": _one("type")},
    "facebook": {"likes": _one("likes"), "comments": _one("comments"), "shares": _one("shares")},
    "web": {"position": _one("position"), "website_title": _one("websiteTitle"), "displayed_url": _one("displayedUrl"), "number_of_reviews": _one("numberOfReviews"), "last_updated": _one("lastUpdated")},
    "normalized": {k: _one(k) for k in ("lang", "created_at", "review", "link", "name", "stars", "date", "description", "reviewUrl")},
}


def shown(rows: DataFrame, extras: dict) -> DataFrame:
    """Mapped rows with the named fields of `extra` as columns."""
    return rows.select("*", *[F.get_json_object("extra", f"$.{k}").alias(f"extra_{k}") for k in extras]).drop("extra")


def _map(name: str) -> None:
    source, url, text, author, rating, created = _MAPS[name]
    items = f"(SELECT v AS item FROM {drawn_sql(_ITEMS[name])})"
    if name == "web":
        items = f"(SELECT unnest(CASE WHEN json_type(item, '$.organicResults') = 'ARRAY' THEN CAST(json_extract(item, '$.organicResults[*]') AS VARCHAR[]) ELSE [item] END) AS item FROM {items})"
    facts = ", ".join(f"{v} AS extra_{k}" for k, v in _EXTRAS[name].items())
    ended = ", ".join(f"extra_{k}" for k in _EXTRAS[name])
    sql = f"""WITH m AS (SELECT {source} AS source, coalesce({url}, '') AS source_url, {author} AS author, TRY_CAST(trim({rating}) AS DOUBLE) AS rating, {text} AS text, {created} AS created_at, {facts} FROM {items})
        SELECT sha256('Acme|' || source || '|' || source_url || '|' || text) AS id, 'Acme' AS brand, source, source_url, author, rating, text, created_at, {ended} FROM m WHERE source_url <> '' AND trim(text) <> ''"""

    @query(sql, "map_web_serp" if name == "web" else f"map_{name}", base=False)
    def run(spark, d):
        rows = drawn(spark, d, _ITEMS[name]).select(F.lit("Acme").alias("brand"), F.lit("partner").alias("source"), F.col("v").alias("item"))
        return shown(mappers.mapper(name)(rows), _EXTRAS[name])


for _m in _MAPS:
    _map(_m)


# ---- the sources that are read directly, with what goes to `extra`

_AT = "strftime(to_timestamp(TRY_CAST({0} AS DOUBLE)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_JOIN = lambda *parts: "concat_ws(chr(10) || chr(10), " + ", ".join(f"nullif(trim({_one(p)}), '')" for p in parts) + ")"
_HOST_TAG = _TAG.replace("coalesce(u,", f"coalesce({_one('url')},")
_FLAT = f"trim(replace(replace(replace(regexp_replace(regexp_replace({_one('content')}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '&lt;', '<'), '&quot;', '\"'), '&amp;', '&'))"
_BODY = f"trim({_any('markdown', 'description')})"
_CUT = f"CASE WHEN length({_BODY}) > 2000 THEN regexp_replace(substring({_BODY}, 1, 2000), ' [^ ]*$', '') || '...' ELSE {_BODY} END"
#: Items, beside columns, and SQL of source, url, text, author, rating, created_at and of the fields in `extra`.
_DIRECT = {
    "app_store": (
        ['{"im:rating": {"label": "4"}, "title": {"label": "T @t T"}, "content": {"label": "C @t C"}, "id": {"label": "9"}, "author": {"name": {"label": "N"}}, "updated": {"label": "2024-01-01T00:00:00-07:00"}, "im:version": {"label": "1.2"}}', '{"title": {"label": "the app"}}', '{"im:rating": {"label": "1"}, "content": {"label": "X @t X"}}', '{"im:rating": {"label": "1"}}'],
        {"app_url": "https://a/app", "app_id": "77", "country": "us"},
        ("'app_store'", f"'https://a/app?see-all=reviews' || coalesce('#review-' || {_one('id.label')}, '')", _JOIN("title.label", "content.label"), _one("author.name.label"), _one('"im:rating".label'), _one("updated.label")),
        {"app_id": "'77'", "country": "'us'", "review_id": _one("id.label"), "version": _one('"im:version".label')}, "json_extract(item, '$.\"im:rating\"') IS NOT NULL",
    ),
    "google_play": (
        ['{"content": " ok @t ok ", "reviewId": "r@n", "score": 5, "userName": "U", "at": "2024-02-02", "thumbsUpCount": 3, "appVersion": "7"}', '{"content": "no id @t no id", "score": 2, "reviewCreatedVersion": "8", "replyContent": "sorry"}', '{"content": " "}'],
        {"app_url": "https://p?id=a", "package": "a"},
        ("'google_play'", f"'https://p?id=a' || coalesce('&reviewId=' || {_one('reviewId')}, '')", f"trim({_one('content')})", _one("userName"), _one("score"), _one("at")),
        {"package": "'a'", "review_id": f"coalesce({_one('reviewId')}, '')", "thumbs_up": _one("thumbsUpCount"), "app_version": _any("reviewCreatedVersion", "appVersion"), "reply": _one("replyContent")}, "true",
    ),
    "hackernews": (
        ['{"objectID": "1@n", "title": "A &amp; B @t A &amp; B ", "comment_text": "<i>c</i>", "created_at_i": 1700000000, "author": "z", "points": 4}', '{"objectID": "1@n", "title": "A &amp; B @t A &amp; B ", "comment_text": "<i>c</i>", "created_at_i": 1700000000, "author": "z", "points": 4}', '{"objectID": "2@n", "story_text": "s @t s", "created_at": "2024-01-01T00:00:00Z"}', '{"title": "no id @t no id"}', '{"objectID": "3@n"}'],
        {}, ("'hackernews'", f"'https://news.ycombinator.com/item?id=' || {_one('objectID')}", _JOIN("title", "story_text", "comment_text"), _one("author"), "NULL", f"coalesce({_AT.format(_one('created_at_i'))}, {_one('created_at')})"),
        {"points": _one("points"), "engine": "'hn_algolia'"}, "true",
    ),
    "mastodon": (
        ['{"url": "https://m/1@n", "content": "<p>hi &lt;you&quot; &amp;  me</p>", "account": {"acct": "a@b"}, "created_at": "2024-03-03", "favourites_count": 2, "reblogs_count": 1}', '{"uri": "https://m/2@n", "content": "<p>x</p>"}', '{"url": "https://m/3@n", "content": "<p> </p>"}', '{"content": "y @t y"}'],
        {}, ("'mastodon'", _any("url", "uri"), _FLAT, _one("account.acct"), "NULL", _one("created_at")),
        {"favourites": _one("favourites_count"), "reblogs": _one("reblogs_count"), "engine": "'mastodon_tag'"}, "true",
    ),
    "reddit_json": (
        ['{"permalink": "/r/x/p@n", "title": " t @t t ", "selftext": "", "author": "[deleted]", "created_utc": 1700000000, "subreddit": "x", "score": 3, "num_comments": 2}', '{"permalink": "/r/x/q@n", "title": "u @t u", "selftext": " v @t v", "author": "w"}', '{"permalink": "/r/x/q@n", "title": "u @t u", "selftext": " v @t v", "author": "w"}', '{"title": "no link @t no link", "url": "https://else/@n"}', '{"permalink": "/r/x/e@n"}'],
        {}, ("'reddit'", f"'https://www.reddit.com' || {_one('permalink')}", _JOIN("title", "selftext"), f"nullif({_one('author')}, '[deleted]')", "NULL", _AT.format(_one("created_utc"))),
        {"subreddit": _one("subreddit"), "score": _one("score"), "num_comments": _one("num_comments"), "engine": "'reddit_json'"}, "true",
    ),
    "reddit_api": (
        ['{"permalink": "/r/x/p@n", "title": " t @t t ", "author": "[deleted]", "created_utc": 1700000000, "subreddit": "x", "ups": 3, "num_comments": 2, "over_18": false}', '{"title": "no permalink @t no permalink", "url": "https://else/@n"}', '{"title": "no link @t no link"}'],
        {}, ("'reddit'", f"coalesce('https://www.reddit.com' || {_one('permalink')}, {_one('url')})", _JOIN("title", "selftext"), _one("author"), "NULL", _AT.format(_one("created_utc"))),
        {"subreddit": _one("subreddit"), "up_votes": _one("ups"), "num_comments": _one("num_comments"), "over_18": _one("over_18")}, "true",
    ),
    "web_search": (
        ['{"url": "https://x.com/1@n", "title": " t @t t ", "content": "c @t c", "published_date": "2024-04-04", "score": 0.5}', '{"url": "https://b.org/@n", "content": "only @t only"}', '{"title": "no url @t no url"}'],
        {}, (_HOST_TAG, _one("url"), _JOIN("title", "content"), "NULL", "NULL", _one("published_date")), {"score": _one("score"), "engine": "'tavily'"}, "true",
    ),
    "web_pages": (
        ['{"url": "https://b.org/@n", "title": "T @t T", "markdown": "body text @t body text"}', '{"url": "https://www.reddit.com/r/a@n", "description": " d @t d "}', '{"markdown": "no url @t no url"}'],
        {}, (_HOST_TAG, _one("url"), f"concat_ws(chr(10) || chr(10), nullif(trim({_one('title')}), ''), nullif({_CUT}, ''))", "NULL", "NULL", "CAST(NULL AS VARCHAR)"), {"engine": "'firecrawl'"}, "true",
    ),
}


def _map_direct(name: str) -> None:
    texts, beside, (source, url, text, author, rating, created), extras, kept = _DIRECT[name]
    facts = ", ".join(f"{v} AS extra_{k}" for k, v in extras.items())
    ended = ", ".join(f"extra_{k}" for k in extras)
    sql = f"""WITH m AS (SELECT {source} AS source, coalesce({url}, '') AS source_url, {author} AS author, TRY_CAST(trim({rating}) AS DOUBLE) AS rating, {text} AS text, {created} AS created_at, {facts} FROM (SELECT v AS item FROM {drawn_sql(texts)}) WHERE {kept})
        SELECT DISTINCT sha256('Acme|' || source || '|' || source_url || '|' || text) AS id, 'Acme' AS brand, source, source_url, author, rating, text, created_at, {ended} FROM m WHERE source_url <> '' AND trim(text) <> ''"""

    @query(sql, f"map_{name}", base=False)
    def run(spark, d):
        item = F.concat(F.lit('{"feed": {"entry": ['), "v", F.lit("]}}")) if name == "app_store" else F.col("v")
        rows = drawn(spark, d, texts).select(F.lit("Acme").alias("brand"), item.alias("item"), *[F.lit(v).alias(k) for k, v in beside.items()])
        return shown(mappers.mapper(name)(rows), extras).distinct()


for _m in _DIRECT:
    _map_direct(_m)

#: A card of each form; a document's words and number come in as text, in entities.
_CARDS = [
    '<article data-service-review-card-paper="true"><h2 data-review-title-typography="x">Good @n</h2><p data-service-review-text-typography="true">@t</p><div data-service-review-rating="5"><img alt="Rated 1 out of 5 stars"></div><a href="/reviews/@n">x</a><time datetime="2024-01-@n"></time></article>',
    '<div class="a styles_reviewCard__x"><p>no</p><a class="reviewTitle__y" href="https://else.example/reviews/@n">Half<br>way</a><p class="reviewText">@t<p class="reviewText">later</p><img alt="Rated 4.5 out of 5 stars"><span class="consumerName__z"> N @n </span></div>',
    '<section><article class="reviewCard"><p class="reviewContent">outer @n<article class="b reviewCard"><p class="reviewContent">inner @t</article></article></section>',
    '<article data-service-review-card-paper=1><script>var x = "<p data-service-review-text-typography>no</p>"</script><a href="reviews/x">y</a></article>',
    '<p class="reviewText">no card, @t</p>',
]
#: source_url, author, rating, text and created_at of the cards of each form; t is the text that a page shows.
_CARD_ROWS = [
    ("'https://www.trustpilot.com/reviews/' || n", "NULL", "5.0", "concat_ws(chr(10) || chr(10), 'Good ' || n, nullif(t, ''))", "'2024-01-' || n"),
    ("'https://else.example/reviews/' || n", "'N ' || n", "4.5", "concat_ws(chr(10) || chr(10), 'Halfway', nullif(t, ''))", "NULL"),
    ("''", "NULL", "NULL", "'outer ' || n", "NULL"),
    ("''", "NULL", "NULL", "regexp_replace('inner ' || t, '\\s+$', '')", "NULL"),
]
_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;")]


@query("WITH d AS (SELECT doc_id % 5 AS form, CAST(doc_id AS VARCHAR) AS n, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents), m AS (" + " UNION ALL ".join(
    f"SELECT {url} AS source_url, CAST({author} AS VARCHAR) AS author, CAST({rating} AS DOUBLE) AS rating, {text} AS text, CAST({created} AS VARCHAR) AS created_at FROM d WHERE form = {min(k, 2)}" for k, (url, author, rating, text, created) in enumerate(_CARD_ROWS)
) + ") SELECT sha256('Acme|trustpilot|' || source_url || '|' || text) AS id, 'Acme' AS brand, 'trustpilot' AS source, source_url, author, rating, text, created_at, 'trustpilot' AS extra_site FROM m", base=False)
def map_trustpilot(spark, d):
    text = F.coalesce("text", F.lit(""))
    for char, entity in _ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    card = F.element_at(F.array(*map(F.lit, _CARDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    pages = table(spark, d, "documents").select(F.lit("Acme").alias("brand"), F.replace(F.replace(card, F.lit("@n"), F.col("doc_id").cast("string")), F.lit("@t"), text).alias("html"))
    return shown(mappers.mapper("trustpilot")(pages), ["site"])


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract_all(html, '<a href="([^"]*)"', 1)[1] AS link, len(regexp_extract_all(html, '<article')) AS articles
    FROM pages WHERE html IS NOT NULL""", base=False)
def page_cards(spark, d):
    """Cards of real pages: the page's language, its first link and how many articles it has."""
    pages = table(spark, d, "pages").where("html is not null")
    whole = html.cards(pages, "html", {"link": (["a[href]"], "href")}, ["page_id", "html"]).select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), "link")
    articles = html.cards(pages, "article", {}, ["page_id"]).groupBy("page_id").agg(F.count("*").alias("articles"))
    return whole.join(articles, "page_id", "left").select("page_id", "lang", "link", F.coalesce("articles", F.lit(0)).alias("articles"))


# ---- upserts and keyed updates

_RAW = "id, brand, source, source_url, author, rating, text, created_at, captured_at"


def _base_and_batch(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nine tenths as a base, and a batch of new rows plus every fifth one twice, changed."""
    base = rows.where("doc_id % 10 <> 0")
    new = rows.where("doc_id % 10 = 0").withColumn("seq", F.col("doc_id") * 10)
    once = rows.where("doc_id % 5 = 1").withColumns({"rating": F.lit(1.0), "captured_at": F.lit("2030-01-01T00:00:00"), "seq": F.col("doc_id") * 10 + 1, "text": F.concat("text", F.lit("!")), "author": F.lit("other")})
    twice = once.withColumns({"rating": F.lit(4.0), "captured_at": F.lit("2030-01-02T00:00:00"), "seq": F.col("doc_id") * 10 + 2})
    return base, new.unionByName(once).unionByName(twice)


@query(f"""SELECT {_RAW.replace("rating", "CASE WHEN doc_id % 5 = 1 THEN 4.0::DOUBLE ELSE rating END AS rating").replace("captured_at", "CASE WHEN doc_id % 5 = 1 THEN '2030-01-02T00:00:00' ELSE captured_at END AS captured_at")}
    FROM reviews""")
def raw_upsert(spark, d):
    rows = reviews(spark, d).withColumn("extra", F.lit("{}"))
    base, batch = _base_and_batch(rows)
    columns = [*[c.strip() for c in _RAW.split(",")], "extra"]
    return store.raw_upsert(base.select(*columns), batch.select("seq", *columns)).drop("extra")


@query("""SELECT id, brand, author, CASE WHEN doc_id % 5 = 1 THEN 4.0::DOUBLE ELSE rating END AS rating, CASE WHEN doc_id % 5 = 1 THEN text || '!' ELSE text END AS text, sentiment,
    CASE WHEN doc_id % 5 = 1 THEN '2030-01-02T00:00:00' ELSE captured_at END AS captured_at, relevant, qc_checked FROM reviews""")
def marts_upsert(spark, d):
    rows = reviews(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    base, batch = _base_and_batch(rows)
    columns = ["id", "brand", "author", "rating", "text", "sentiment", "embedding", "captured_at", "relevant", "qc_checked"]
    return store.served_upsert(base.select(*columns), batch.select("seq", *columns)).drop("embedding")


#: Tables hold a key once: here each document has a key of its own, also where contents are equal.
KEYED = "FROM (SELECT * REPLACE (id || '-' || doc_id AS id) FROM reviews) AS reviews"


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.concat_ws("-", "id", F.col("doc_id").cast("string")))


def _kept(spark, base: DataFrame, batch: DataFrame, schema, updates: list[str]) -> DataFrame:
    """The same through a bucketed table: the base is loaded, then the batch changes the buckets it touches."""
    held = tables.BucketedTable(spark, shared_folder(spark, "table"), schema, 16)
    held.upsert(base.withColumn("seq", F.lit(0)), updates, stream="load", batch_id=0)
    held.upsert(batch, updates, stream="load", batch_id=1)
    held.upsert(batch.withColumn("captured_at", F.lit("never")), updates, stream="load", batch_id=1)  # a replay changes nothing
    return held.read()


@query(ORACLE["raw_upsert"].replace("FROM reviews", KEYED), base=False)
def raw_table_upsert(spark, d):
    base, batch = _base_and_batch(keyed(reviews(spark, d)).withColumn("extra", F.lit("{}")))
    columns = [f.name for f in RAW_SCHEMA]
    return _kept(spark, base.select(*columns), batch.select("seq", *columns), RAW_SCHEMA, store.RAW_UPDATES).drop("extra")


@query(ORACLE["marts_upsert"].replace("FROM reviews", KEYED), base=False)
def marts_table_upsert(spark, d):
    base, batch = _base_and_batch(keyed(reviews(spark, d)).withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    columns = [f.name for f in SERVED_SCHEMA]
    rows = _kept(spark, base.select(*columns), batch.select("seq", *columns), SERVED_SCHEMA, store.SERVED_UPDATES)
    return rows.select("id", "brand", "author", "rating", "text", "sentiment", "captured_at", "relevant", "qc_checked")


def _changed(column: str, value: str) -> str:
    return f"CASE WHEN doc_id % 5 = 1 THEN {value} ELSE {column} END AS {column}"


@query(f"""SELECT id, {_changed("rating", "4.0::DOUBLE")}, {_changed("captured_at", "'2030-01-02T00:00:00'")} {KEYED} WHERE doc_id % 10 = 0 OR doc_id % 5 = 1""")
def raw_changes(spark, d):
    """The change feed: what a batch has inserted or changed since the version before it."""
    base, batch = _base_and_batch(keyed(reviews(spark, d)).withColumn("extra", F.lit("{}")))
    columns = [f.name for f in RAW_SCHEMA]
    held = tables.BucketedTable(spark, shared_folder(spark, "table"), RAW_SCHEMA, 16)
    before = held.upsert(base.select(*columns).withColumn("seq", F.lit(0)), store.RAW_UPDATES)
    held.upsert(batch.select("seq", *columns), store.RAW_UPDATES)
    return held.changes(before).select("id", "rating", "captured_at")


@query(f"WITH {felt_sql('(SELECT doc_id AS key, text FROM reviews)')} SELECT id, brand, rating, CASE WHEN rating IS NOT NULL THEN sentiment ELSE {_FELT} END AS sentiment, 64 AS dimensions {KEYED} JOIN felt ON key = doc_id")
def stream_ingest(spark, d):
    """Reviews as a stream of files: upserted raw, enriched, served; the batch after the last is a replay."""
    rows = keyed(reviews(spark, d)).withColumn("extra", F.lit("{}")).select(*[f.name for f in RAW_SCHEMA])
    folder, root = shared_folder(spark, "files"), shared_folder(spark, "store")
    # three micro-batches: each task writes a file for each
    rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3))).write.partitionBy("part").json(folder)
    files = tables.Folder(spark, folder)
    each = -(-sum(n.endswith(".json") for p in files.names() for n in files.names(p)) // 3)
    source = spark.readStream.schema(RAW_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max(1, each)).json(folder)
    pipeline.run(spark, source, root, shared_folder(spark, "offsets"), once=True, buckets=16).awaitTermination()
    held = pipeline.Store(spark, root, 16)
    pipeline.ingest(held, rows.withColumn("rating", F.lit(0.0)), 0)
    return held.served.read().select("id", "brand", "rating", "sentiment", F.size("embedding").alias("dimensions"))


_TRUSTED = ", ".join(f"'{s}'" for s in TRUSTED)


@query(f"SELECT id, CASE WHEN qc_checked IS NOT TRUE AND source IN ({_TRUSTED}) THEN true ELSE relevant END AS relevant, CASE WHEN qc_checked IS NOT TRUE AND source IN ({_TRUSTED}) THEN true ELSE qc_checked END AS qc_checked FROM reviews")
def qc_trusted(spark, d):
    return store.trust_sources(reviews(spark, d)).select("id", "relevant", "qc_checked")


@query(f"SELECT id, brand FROM reviews WHERE qc_checked IS NOT TRUE AND NOT source IN ({_TRUSTED}) ORDER BY {_NEWEST} LIMIT 600")
def qc_pending(spark, d):
    return store.pending_checks(reviews(spark, d)).select("id", "brand")


@query("""SELECT id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE relevant END AS relevant, CASE WHEN doc_id % 3 = 0 AND rating IS NULL THEN 'neutral' ELSE sentiment END AS sentiment,
    CASE WHEN doc_id % 3 = 0 THEN true ELSE qc_checked END AS qc_checked FROM reviews""")
def qc_apply_verdicts(spark, d):
    rows = reviews(spark, d)
    verdicts = rows.where("doc_id % 3 = 0").select("id", (F.col("doc_id") % 2 == 0).alias("relevant"), F.lit("neutral").alias("sentiment"))
    return store.apply_verdicts(rows, verdicts).select("id", "relevant", "sentiment", "qc_checked")


@query("""SELECT id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE relevant END AS relevant, CASE WHEN doc_id % 3 = 0 AND rating IS NULL THEN 'negative' ELSE sentiment END AS sentiment FROM reviews""")
def qc_last_verdict(spark, d):
    rows = reviews(spark, d)
    first = rows.where("doc_id % 3 = 0").select("id", F.lit(True).alias("relevant"), F.lit("positive").alias("sentiment"), F.lit(1).alias("seq"))
    last = rows.where("doc_id % 3 = 0").select("id", (F.col("doc_id") % 2 == 0).alias("relevant"), F.lit("negative").alias("sentiment"), F.lit(2).alias("seq"))
    return store.apply_verdicts(rows, last.unionByName(first)).select("id", "relevant", "sentiment")


_HISTORY = "SELECT brand, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, CAST(count(*) AS INTEGER) AS reviews_found, 'ok' AS status, max(created_at) AS started_at FROM reviews WHERE created_at IS NOT NULL GROUP BY brand"


def _runs(name: str, where: str, limit: int, brand: str | None) -> None:
    @query(f"SELECT * FROM ({_HISTORY}) WHERE {where} ORDER BY started_at DESC, brand LIMIT {limit}", name)
    def run(spark, d):
        sources = F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources")
        rows = reviews(spark, d).where("created_at is not null").groupBy("brand")
        history = rows.agg(sources, F.count("*").cast("int").alias("reviews_found"), F.lit("ok").alias("status"), F.max("created_at").alias("started_at"))
        return store.runs(history, limit, brand)


_runs("runs_list", "true", 10, None)
_runs("runs_list_brand", "brand ILIKE 'brand#1_'", 50, "brand#1_")


#: Replies of a judge that was shown three rows, and what they say of each: (index, relevant, sentiment).
_REPLIES = [
    ('{"items": [{"i": 0, "relevant": true, "sentiment": "Positive"}, {"i": "1", "relevant": false, "sentiment": "bad"}, {"i": 9, "relevant": true}, {"i": "x", "relevant": true}, {"i": 2, "relevant": "no", "sentiment": null}]}', [(0, "true", "positive"), (1, "false", "neutral"), (2, "true", "neutral")]),
    ("not json, @t", []),
    ('{"items": [{"i": 2, "relevant": 0, "sentiment": "NEGATIVE", "why": "@t"}, {"relevant": true}, {"i": 1.0, "relevant": "@t @n"}]}', [(2, "false", "negative"), (1, "true", "neutral")]),
    ('{"items": []}', []),
]
_SAID = ", ".join(f"({k}, {i}, {ok}, '{said}')" for k, (_, rows) in enumerate(_REPLIES) for i, ok, said in rows)


@query(f"""SELECT 'r' || d.doc_id || '-' || i AS id, relevant, sentiment FROM documents d JOIN (VALUES {_SAID}) AS t(form, i, relevant, sentiment) ON form = d.doc_id % {len(_REPLIES)}""", base=False)
def qc_parse(spark, d):
    ids = F.array(*[F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit(f"-{i}")) for i in range(3)])
    return store.parse_verdicts(drawn(spark, d, [r for r, _ in _REPLIES]).select(ids.alias("ids"), F.col("v").alias("reply")))


@query("SELECT id, brand FROM reviews WHERE doc_id % 4 = 1 OR doc_id % 6 = 2")
def enrich_pending(spark, d):
    rows = reviews(spark, d)
    served = rows.where("doc_id % 4 <> 1").withColumn("text", F.when(F.col("doc_id") % 6 == 2, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return store.pending_enrichment(rows, served).select("id", "brand")


@query(f"""WITH {felt_sql("(SELECT doc_id AS key, text FROM reviews WHERE doc_id % 4 = 1)")} SELECT id, CASE WHEN rating IS NOT NULL THEN sentiment ELSE {_FELT} END AS sentiment FROM reviews JOIN felt ON key = doc_id""")
def enriched(spark, d):
    rows = reviews(spark, d)
    served = rows.where("doc_id % 4 <> 1").withColumn("embedding", F.lit(None).cast("array<float>"))
    return enrich.enriched(rows.drop("sentiment", "relevant", "qc_checked"), served).select("id", "sentiment")


@query("""WITH f AS (SELECT * FROM reviews WHERE doc_id % 4 = 1), k AS (SELECT count(DISTINCT id) AS new_ids FROM f)
    SELECT source, count(*) AS new_rows, any_value(k.new_ids) AS new_ids, any_value(k.new_ids) >= 200 AS at_target, any_value(k.new_ids) >= 150 AS at_floor FROM f, k GROUP BY source""")
def collect_tally(spark, d):
    rows = reviews(spark, d)
    return enrich.collection_tally(rows, rows.where("doc_id % 4 <> 1"))


@query("""WITH f AS (SELECT brand, id, captured_at, CAST(substring(brand, 7) AS INTEGER) % 2 = 1 AS known FROM reviews WHERE sentiment = 'negative' AND doc_id % 3 <> 0),
    o AS (SELECT brand, id, row_number() OVER (PARTITION BY brand ORDER BY captured_at DESC NULLS FIRST, id) AS place FROM f WHERE known)
    SELECT brand, 'baseline' AS kind, NULL AS id, count(*) AS n FROM f WHERE NOT known GROUP BY brand
    UNION ALL SELECT brand, 'alert', id, 1 FROM o WHERE place <= 5 UNION ALL SELECT brand, 'overflow', NULL, count(*) FROM o WHERE place > 5 GROUP BY brand""")
def alerts_plan(spark, d):
    rows = reviews(spark, d)
    alerted = rows.where("doc_id % 3 = 0").select("id")
    seen = rows.where(F.substring("brand", 7, 9).cast("int") % 2 == 1).select("brand").distinct()
    return alerts.plan(rows, alerted, seen)


_JUDGED = "CASE length(substring(text, 1, 600)) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END"


def _judge_by_length(brand: str, texts: list[str]) -> list[tuple[int, bool, str]]:
    """A stand-in judge; it says nothing about every seventh length."""
    return [(i, (len(t) + int(brand.removeprefix("Brand#"))) % 2 == 0, ("positive", "neutral", "negative")[len(t) % 3]) for i, t in enumerate(texts) if len(t) % 7]


@query(f"""WITH t AS (SELECT id, brand, source, text, rating, captured_at, sentiment, CASE WHEN qc_checked IS NOT TRUE AND source IN ({_TRUSTED}) THEN true ELSE relevant END AS relevant, CASE WHEN qc_checked IS NOT TRUE AND source IN ({_TRUSTED}) THEN true ELSE qc_checked END AS qc_checked FROM reviews),
    p AS (SELECT id, (length(substring(text, 1, 600)) + CAST(substring(brand, 7) AS INTEGER)) % 2 = 0 AS ok, {_JUDGED} AS said FROM (SELECT * FROM t WHERE qc_checked IS NOT TRUE AND NOT source IN ({_TRUSTED}) ORDER BY {_NEWEST} LIMIT 600) WHERE length(substring(text, 1, 600)) % 7 <> 0),
    v AS (SELECT id, any_value(ok) AS ok, any_value(said) AS said FROM p GROUP BY id)
    SELECT t.id, CASE WHEN v.id IS NULL THEN relevant ELSE ok END AS relevant, CASE WHEN v.id IS NOT NULL AND rating IS NULL THEN said ELSE sentiment END AS sentiment, v.id IS NOT NULL OR qc_checked AS qc_checked FROM t LEFT JOIN v ON v.id = t.id""")
def qc_cycle(spark, d):
    """Trusted rows, then a judge over the newest unchecked ones, and its verdicts laid over the table."""
    rows = store.trust_sources(reviews(spark, d))
    verdicts = enrich.judge(store.pending_checks(rows), _judge_by_length)
    return store.apply_verdicts(rows, verdicts).select("id", "relevant", "sentiment", "qc_checked")


_MADE = "substring(CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN ' ' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, 1, 8000)"


@query(f"SELECT id, length({_MADE}) AS a, length({_MADE}) - length(replace({_MADE}, 'e', '')) AS b, 2 AS dimensions FROM reviews")
def embed_batch(spark, d):
    """A provider gets prepared texts in order, at most 96 a call."""

    def provider(texts: list[str]) -> list[list[int]]:
        if len(texts) > 96:
            raise ValueError("too many texts in a call")
        return [[len(t), t.count("e")] for t in texts]

    e = F.col("embedding")
    return enrich.embed(reviews(spark, d).select("id", "text"), provider).select("id", e[0].cast("long").alias("a"), e[1].cast("long").alias("b"), F.size(e).alias("dimensions"))


@query(f"""WITH n AS (SELECT id, brand, captured_at, doc_id % 2 AS part {KEYED} WHERE sentiment = 'negative'), o AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY captured_at DESC NULLS FIRST, id) AS place FROM n WHERE part = 1 AND brand IN (SELECT brand FROM n WHERE part = 0))
    SELECT brand, 'baseline' AS kind, NULL AS id, count(*) AS n FROM n WHERE part = 0 OR brand NOT IN (SELECT brand FROM n WHERE part = 0) GROUP BY brand
    UNION ALL SELECT brand, 'alert', id, 1 FROM o WHERE place <= 5 UNION ALL SELECT brand, 'overflow', NULL, count(*) FROM o WHERE place > 5 GROUP BY brand""")
def notices(spark, d):
    """Two batches of served rows: what goes to the outbox for each, with what was alerted kept in between."""
    rows = keyed(reviews(spark, d)).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("seq", F.lit(0))
    held = pipeline.Store(spark, shared_folder(spark, "store"), 8)
    for part in (0, 1):
        held.served.upsert(rows.where(F.col("doc_id") % 2 == part), store.SERVED_UPDATES)
        pipeline.plan_notices(held)
        pipeline.plan_notices(held)  # a second call finds nothing new
    return held.outbox.read().select("brand", "kind", "id", "n")


_STAGED_AT = "CASE WHEN doc_id % 50 = 3 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * CAST((doc_id * 7919) % 1000003 AS INTEGER) END"


@query(f"""WITH s AS (SELECT doc_id, text, url FROM documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages) WHERE doc_id % 50 <> 3 OR doc_id % 100 = 3),
    n AS (SELECT *, {_STAGED_AT} AS extracted FROM s ORDER BY extracted DESC NULLS FIRST LIMIT 200)
    SELECT sha256('Acme|yelp|' || url || '|' || text) AS id, 'Acme' AS brand, 'yelp' AS source, url AS source_url, CAST(nullif(doc_id % 5, 0) AS DOUBLE) AS rating, text FROM n WHERE trim(text) <> '' AND url <> ''""", base=False)
def staging_import(spark, d):
    """Staged rows of which the newest 200 are mapped, those without a time first."""
    pages = table(spark, d, "pages")
    n = pages.count()
    rows = table(spark, d, "documents").withColumn("page_id", F.col("doc_id") % n).join(pages.select("page_id", "url"), "page_id").where("doc_id % 50 <> 3 or doc_id % 100 = 3")
    item = F.to_json(F.struct("text", "url", (F.col("doc_id") % 5).alias("rating")))
    staged = rows.select(item.alias(staging.LEGACY), F.expr("CASE WHEN doc_id % 50 <> 3 THEN timestamp'2024-01-01' + make_dt_interval(0, 0, 0, (doc_id * 7919) % 1000003) END").alias(staging.EXTRACTED_AT))
    return staging.import_rows(staging.newest(staged, 200), "Acme", "yelp").select("id", "brand", "source", "source_url", "rating", "text")


@query(f"SELECT {_LISTED} FROM reviews WHERE {RELEVANT} ORDER BY {_SORTS['recent']} LIMIT 40")
def reviews_unknown_sort(spark, d):
    return R.listed(reviews(spark, d), sort="no such sort")


_SLUG = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"WITH n AS (SELECT brand AS name FROM reviews UNION ALL SELECT substring(text, 1, 60) FROM reviews UNION ALL SELECT source_url FROM reviews UNION ALL SELECT author FROM reviews) SELECT name, CASE WHEN {_SLUG.format('name')} = '' THEN 'all' ELSE {_SLUG.format('name')} END AS slug FROM n")
def slugs(spark, d):
    rows = reviews(spark, d)
    names = rows.select(F.explode(F.array("brand", F.substring("text", 1, 60), "source_url", "author")).alias("name"))
    return names.select("name", X.slug(F.col("name")).alias("slug"))


#: Replies of a generator: an object alone, in prose, broken, or none.
_SAYS = ['{"n": "@n", "text": "@t"}', 'Sure, here it is: {"n": "@n", "more": {"text": "@t"}} I hope it helps.', '{"n": "@n", "text": "@t"', "no object, @n", "[1, @n]", None]


@query(f"SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN CAST(doc_id AS VARCHAR) END AS n FROM documents", base=False)
def lenient_object(spark, d):
    rows = drawn(spark, d, _SAYS).withColumn("o", report.lenient_object(F.col("v")))
    return rows.select("doc_id", F.get_json_object("o", "$.n").alias("n"))


@query(f"WITH b AS (SELECT brand, {_BLOCK} FROM reviews WHERE {RELEVANT} AND brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY brand), s AS (SELECT *, {_SCORE} AS health FROM b) SELECT brand, total, health, true AS listed FROM s")
def report_saved(spark, d):
    """Reports saved as snapshots, found again in the list of their brand and by their token."""
    path, rows = shared_folder(spark, "reports"), reviews(spark, d)
    found = None
    tokens = {}
    for k, brand in enumerate(("Brand#1", "Brand#2", "Brand#3")):
        payload = report.facts(rows, brand).select(F.to_json(F.struct("*")).alias("p")).first()["p"]
        tokens[brand] = report.save(spark, path, brand, payload, f"2024-01-0{k + 1}T00:00:00Z")
    held = spark.read.parquet(path)
    for brand, token in tokens.items():
        one = report.shared(held, token).join(report.saved(held, brand.upper()).select("token", F.lit(True).alias("listed")), "token", "left")
        found = one if found is None else found.unionByName(one)
    get = lambda c, kind: F.get_json_object("payload", f"$.{c}").cast(kind).alias(c)
    return found.select("brand", get("total", "long"), get("health", "int"), "listed")


# ---- retrieval


def _vector(spark, d) -> list[float]:
    """The query vector is one row of the table."""
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_SCORED = f"""WITH v AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), c AS (SELECT r.*, list_cosine_similarity(e.embedding::DOUBLE[], v.q::DOUBLE[]) AS exact, round(list_cosine_similarity(e.embedding::DOUBLE[], v.q::DOUBLE[]), 6) AS score
    FROM reviews r JOIN embeddings e ON e.vec_id = r.doc_id % (SELECT count(*) FROM embeddings), v WHERE {RELEVANT})"""


@query(f"{_SCORED} SELECT id, brand, score FROM c ORDER BY exact DESC, id LIMIT 8")
def rag_topk(spark, d):
    return retrieve.nearest(reviews(spark, d, True), _vector(spark, d)).select("id", "brand", "score")


@query(f"{_SCORED} SELECT id, brand, score FROM c WHERE brand ILIKE '{BRAND}' ORDER BY exact DESC, id LIMIT 8")
def rag_topk_brand(spark, d):
    return retrieve.nearest(reviews(spark, d, True), _vector(spark, d), BRAND).select("id", "brand", "score")


@query(f"""{_SCORED}, p AS (SELECT *, CASE brand WHEN '{BRAND}' THEN 0 ELSE 1 END AS brand_no, row_number() OVER (PARTITION BY brand ORDER BY exact DESC, id) AS place FROM c WHERE brand IN ('{BRAND}', '{OTHER_BRAND}') QUALIFY place <= 6)
    SELECT id, brand, score, brand_no, CAST(place AS INTEGER) AS place FROM p QUALIFY row_number() OVER (PARTITION BY source_url, text ORDER BY brand_no, place) = 1""")
def rag_multi_brand(spark, d):
    found = retrieve.nearest_of_brands(reviews(spark, d, True), _vector(spark, d), [BRAND, OTHER_BRAND])
    return found.select("id", "brand", "score", "brand_no", "place")


_TOP = f"{_SCORED}, t AS (SELECT *, CAST(row_number() OVER (ORDER BY exact DESC, id) AS INTEGER) AS n FROM c WHERE brand ILIKE '{BRAND}' QUALIFY n <= 8)"


@query(f"""{_TOP} SELECT CASE WHEN max(score) >= 0.5 AND count(*) >= 3 THEN 'High' WHEN max(score) >= 0.35 AND count(*) >= 2 THEN 'Medium' ELSE 'Low' END AS confidence, count(*) AS reviews,
    CAST(count(DISTINCT source) AS INTEGER) AS sources, array_to_string(list_sort(list(DISTINCT source)), ',') AS source_types FROM t""")
def rag_confidence(spark, d):
    return retrieve.confidence(retrieve.nearest(reviews(spark, d, True), _vector(spark, d), BRAND))


_FLATTEN = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(rf"{_TOP} SELECT n, '- ' || CASE WHEN length({_FLATTEN}) > 220 THEN regexp_replace(substring({_FLATTEN}, 1, 220), '\s+$', '') || '...' ELSE {_FLATTEN} END || ' [' || n || ']' AS line FROM t WHERE n <= 5")
def rag_extractive(spark, d):
    return retrieve.extractive(retrieve.nearest(reviews(spark, d, True), _vector(spark, d), BRAND))


@query(f"{_TOP} SELECT n, source, source_url, author, rating, {_EXCERPT.format(n=280, suffix='…')} AS excerpt, score FROM t")
def rag_citations(spark, d):
    return retrieve.citations(retrieve.nearest(reviews(spark, d, True), _vector(spark, d), BRAND))


def _indexed(spark, d) -> vectors.VectorIndex:
    rows = reviews(spark, d, True).select("id", "brand", "relevant", "embedding")
    return vectors.VectorIndex.build(rows, shared_folder(spark, "vectors"))


@query(f"{_SCORED} SELECT id, brand, score FROM c ORDER BY exact DESC, id LIMIT 8")
def rag_index_topk(spark, d):
    found, _ = _indexed(spark, d).search(_vector(spark, d), 8, "relevant is not false")
    return found.select("id", "brand", "score")


@query(f"{_SCORED} SELECT id, brand, score FROM c WHERE brand ILIKE '{BRAND}' ORDER BY exact DESC, id LIMIT 8")
def rag_index_brand(spark, d):
    found, _ = _indexed(spark, d).search(_vector(spark, d), 8, f"relevant is not false and brand ilike '{BRAND}'")
    return found.select("id", "brand", "score")


# ---- word vectors: which words stand near which

_COMMON = 200


def _pairs_sql(tail: str) -> str:
    return rf"""WITH w AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT row_number() OVER () AS row, {_WORDS} AS w FROM documents)),
        v AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS k FROM w GROUP BY word HAVING count(*) >= 5 QUALIFY k < {_COMMON}), n AS MATERIALIZED (SELECT row, i, k FROM w JOIN v USING (word)),
        near AS (SELECT x.k AS a, y.k AS b, {meaning.WINDOW + 1} - abs(x.i - y.i) AS c FROM n x JOIN n y ON x.row = y.row AND y.i BETWEEN x.i - {meaning.WINDOW} AND x.i + {meaning.WINDOW} AND x.i <> y.i),
        p AS (SELECT a, b, sum(c)::BIGINT AS c FROM near GROUP BY ALL), s AS (SELECT a, sum(c) AS n FROM p GROUP BY a), t AS (SELECT sum(n) AS total FROM s) {tail}"""


@query(_pairs_sql("SELECT x.word AS a, y.word AS b, c FROM p JOIN v x ON x.k = a JOIN v y ON y.k = b"), base=False)
def word_pairs(spark, d):
    docs = table(spark, d, "documents")
    words = [w for w, _ in meaning.vocabulary(docs, _COMMON)]
    name = lambda c: F.element_at(F.array(*map(F.lit, words)), (F.col(c) + 1).cast("int"))
    return meaning.pair_counts(docs, words).select(name("a").alias("a"), name("b").alias("b"), "c")


@query(_pairs_sql("SELECT p.a, p.b, round(ln(c * total::DOUBLE / (x.n * y.n::DOUBLE)), 6) AS m FROM p JOIN s x ON x.a = p.a JOIN s y ON y.a = p.b, t WHERE ln(c * total::DOUBLE / (x.n * y.n::DOUBLE)) > 0"), base=False)
def word_information(spark, d):
    docs = table(spark, d, "documents")
    rows = meaning.information(meaning.pair_counts(docs, [w for w, _ in meaning.vocabulary(docs, _COMMON)]))
    return rows.select("a", "b", F.round("m", 6).alias("m"))


# ---- text mining over the newest 60 rows of a brand


def _terms_sql(tail: str) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in insights.stop_words(BRAND))
    return f"""WITH {REVIEWS_SQL}, s AS (SELECT id, text, sentiment FROM reviews WHERE brand ILIKE '{BRAND}' AND text IS NOT NULL ORDER BY {_NEWEST} LIMIT 60),
        w AS (SELECT id, sentiment, list_filter({_WORDS}, lambda x: x NOT IN ({stop})) AS w FROM s),
        b AS (SELECT id, sentiment, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM w),
        x AS (SELECT id, sentiment, unnest(terms) AS term FROM b), tf AS (SELECT id, sentiment, term, count(*) AS tf FROM x GROUP BY ALL), n AS (SELECT count(*) AS n_docs FROM s),
        df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term), p AS (SELECT * FROM df, n WHERE df >= CASE WHEN n_docs >= 6 THEN 2 ELSE 1 END ORDER BY total DESC, term LIMIT 500),
        r AS (SELECT tf.id, tf.sentiment, term, (1 + ln(tf.tf)) * (ln((1 + n_docs) / (1 + df)) + 1) AS w FROM tf JOIN p USING (term)),
        weights AS (SELECT id, sentiment, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM r) {tail}"""


def _top(label: str) -> str:
    return f"SELECT term, round(sum(weight), 6) AS sum_weight FROM weights WHERE sentiment = '{label}' GROUP BY term ORDER BY sum_weight DESC, term LIMIT 5"


def _mined(spark, d):
    return insights.weights(R.sample(reviews(spark, d), BRAND), insights.stop_words(BRAND))


@query(_terms_sql("SELECT term, count(*) AS docs, round(sum(weight), 6) AS sum_weight FROM weights GROUP BY term"), base=False)
def tfidf_terms(spark, d):
    return _mined(spark, d).groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("weight"), 6).alias("sum_weight"))


@query(_terms_sql(_top("positive")), base=False)
def pros_terms(spark, d):
    return insights.top_terms(_mined(spark, d).where("sentiment = 'positive'"))


@query(_terms_sql(_top("negative")), base=False)
def cons_terms(spark, d):
    return insights.top_terms(_mined(spark, d).where("sentiment = 'negative'"))


def _themes_sql(rounds: int = insights.ROUNDS, most: int = 6) -> str:
    """Starts and rounds of the themes, unrolled."""
    steps = [f""", docs AS MATERIALIZED (SELECT id, any_value(sentiment) AS sentiment FROM s WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY id),
        vec AS MATERIALIZED (SELECT id, term, CAST(round(weight * {insights.UNIT}) AS BIGINT) AS w FROM weights), size AS MATERIALIZED (SELECT count(*) AS n, (SELECT count(DISTINCT term) FROM vec) AS terms FROM docs),
        k AS MATERIALIZED (SELECT CASE WHEN n < 4 OR terms < 2 THEN 0 ELSE greatest(2, least(6, CASE WHEN n < 12 THEN 2 ELSE n // 12 END, terms)) END AS k FROM size),
        dot AS MATERIALIZED (SELECT a.id AS a, b.id AS b, sum(a.w * b.w)::BIGINT AS d FROM vec a JOIN vec b USING (term) GROUP BY ALL),
        own AS MATERIALIZED (SELECT docs.id, coalesce(d, 0) AS q FROM docs LEFT JOIN dot ON a = docs.id AND b = docs.id),
        apart AS MATERIALIZED (SELECT x.id AS a, y.id AS b, x.q + y.q - 2 * coalesce(d, 0) AS d, y.q - 2 * coalesce(d, 0) AS far FROM own x, own y LEFT JOIN dot ON dot.a = x.id AND dot.b = y.id),
        start0 AS MATERIALIZED (SELECT 0 AS theme, min(id) AS id FROM docs)"""]
    for j in range(1, most):
        steps.append(f"start{j} AS MATERIALIZED (FROM start{j - 1} UNION ALL SELECT {j}, a FROM (SELECT a, min(d) AS d FROM apart WHERE b IN (SELECT id FROM start{j - 1}) GROUP BY a ORDER BY d DESC, a LIMIT 1), k WHERE k > {j})")
    steps.append(f"round0 AS MATERIALIZED (SELECT a AS id, theme FROM apart JOIN start{most - 1} st ON st.id = b WHERE (SELECT k FROM k) > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY far, theme) = 1)")
    far, square = "(1000::HUGEINT * (m.q - 2 * m.c * coalesce(d, 0)))", "(m.c * m.c)"
    floor = f"({far} - ({far} % {square} + {square}) % {square}) // {square}"
    for r in range(1, rounds + 1):
        last = f"round{r - 1}"
        steps.append(f"""sum{r} AS MATERIALIZED (SELECT theme, term, sum(w)::BIGINT AS s FROM {last} JOIN vec USING (id) GROUP BY ALL),
            mean{r} AS MATERIALIZED (SELECT theme, c, coalesce(q, 0) AS q FROM (SELECT theme, count(*) AS c FROM {last} GROUP BY theme) LEFT JOIN (SELECT theme, sum(s * s)::BIGINT AS q FROM sum{r} GROUP BY theme) USING (theme)),
            far{r} AS MATERIALIZED (SELECT id, theme, sum(w * s)::BIGINT AS d FROM vec JOIN sum{r} USING (term) GROUP BY ALL),
            round{r} AS MATERIALIZED (SELECT docs.id, m.theme FROM docs CROSS JOIN mean{r} m LEFT JOIN far{r} f ON f.id = docs.id AND f.theme = m.theme
                QUALIFY row_number() OVER (PARTITION BY docs.id ORDER BY {floor}, m.theme) = 1)""")
    tone = "CASE WHEN positive >= neutral AND positive >= negative THEN 'positive' WHEN neutral >= negative THEN 'neutral' ELSE 'negative' END"
    return ", ".join(steps) + f""", labelled AS (SELECT * FROM round{rounds} JOIN docs USING (id)),
        facts AS (SELECT theme, count(*) AS mentions, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative FROM labelled GROUP BY theme),
        best AS (SELECT theme, term, row_number() OVER (PARTITION BY theme ORDER BY round(sum(weight), 6) DESC, term) AS n FROM labelled JOIN weights USING (id) GROUP BY theme, term),
        terms AS (SELECT theme, list(term ORDER BY n) AS t FROM best WHERE n <= 3 GROUP BY theme)
        SELECT theme, upper(t[1][1]) || t[1][2:] AS name, mentions, {tone} AS sentiment, 'About ' || mentions || ' reviews, most often on ' || array_to_string(t, ', ') || '; mostly ' || {tone} || '.' AS description
        FROM facts JOIN terms USING (theme) ORDER BY mentions DESC, theme LIMIT 6"""


@query(_terms_sql(_themes_sql()), base=False)
def themes(spark, d):
    return insights.themes(R.sample(reviews(spark, d), BRAND), insights.stop_words(BRAND))


def _pct(c: str) -> str:
    return f"CAST(coalesce(round_even(100.0::DOUBLE * {c} / nullif(reviews, 0), 0), 0) AS INTEGER) AS {c}_pct"


@query(f"""WITH s AS (SELECT * FROM reviews WHERE brand ILIKE '{BRAND}' AND text IS NOT NULL ORDER BY {_NEWEST} LIMIT 60), f AS (SELECT {_BLOCK.replace("AS total", "AS reviews")} FROM s WHERE trim(text) <> '')
    SELECT *, {_pct("positive")}, {_pct("neutral")}, {_pct("negative")}, CASE WHEN positive > 2 * negative THEN 'Praise outweighs complaints by more than two to one.'
        WHEN negative > positive THEN 'Complaints outnumber praise.' ELSE 'Praise and complaints are close to even.' END AS behavior FROM f""")
def insights_summary(spark, d):
    return insights.summary(R.sample(reviews(spark, d), BRAND))


def _named(label: str, column: str) -> str:
    return f"SELECT coalesce(string_agg(upper(term[1]) || term[2:], ', ' ORDER BY sum_weight DESC, term), '') AS {column}, coalesce(first(term ORDER BY sum_weight DESC, term), '') AS {column}_first FROM ({_top(label)})"


@query(_terms_sql(f""", facts AS (SELECT {_BLOCK.replace("AS total", "AS reviews")} FROM (SELECT * FROM reviews WHERE brand ILIKE '{BRAND}' AND text IS NOT NULL ORDER BY {_NEWEST} LIMIT 60) WHERE trim(text) <> ''), praise AS ({_named("positive", "pros")}), blame AS ({_named("negative", "cons")})
    SELECT facts.*, {_pct("positive")}, {_pct("neutral")}, {_pct("negative")}, pros, cons, CASE WHEN positive > 2 * negative THEN 'Praise outweighs complaints by more than two to one.' WHEN negative > positive THEN 'Complaints outnumber praise.'
        ELSE 'Praise and complaints are close to even.' END || CASE WHEN pros <> '' AND cons <> '' THEN ' Praise is mostly about ' || lower(pros_first) || ', complaints about ' || lower(cons_first) || '.' ELSE '' END AS behavior FROM facts, praise, blame"""), base=False)
def insights_report(spark, d):
    rows = insights.report(R.sample(reviews(spark, d), BRAND), insights.stop_words(BRAND))
    return rows.withColumns({c: F.array_join(c, ", ") for c in ("pros", "cons")})
