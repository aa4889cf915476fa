"""Scalar rules as Column expressions: fallbacks, hosts, excerpts, dates, sentiment, health."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.taxonomy import CATEGORIES, GENERIC_BRAND_WORDS, HOSTS, OTHER, SOURCES
from tidewater.functions.valence import compound

WORD = r"[\p{L}\p{N}_]{2,}"


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty; the last one as it is, if none."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def strip(value: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def to_rating(value: Column) -> Column:
    return value.try_cast("double")


def join_parts(*parts: Column) -> Column:
    """Non-empty parts with a blank line between."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")


def host_of(url: Column) -> Column:
    return F.split_part(F.element_at(F.split(F.lower(F.coalesce(url, F.lit(""))), "://"), -1), F.lit("/"), F.lit(1))


def source_from_url(url: Column, default: str = "web") -> Column:
    """The source of the first listed host that a link's host equals or is under."""
    host = host_of(url)
    found = F.lit(default)
    for name, source in reversed(HOSTS):
        found = F.when((host == name) | host.endswith("." + name), F.lit(source)).otherwise(found)
    return found


def bare_domain(url: Column) -> Column:
    host = host_of(strip(url))
    return F.nullif(F.when(host.startswith("www."), F.substring(host, 5, 1_000_000)).otherwise(host), F.lit(""))


def platform_host(url: Column) -> Column:
    """Host of a link with a scheme; empty without one."""
    return F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def category(source: Column) -> Column:
    return F.coalesce(_lookup([(s, c) for s, c, _ in SOURCES], source), F.lit(OTHER))


def label(source: Column) -> Column:
    return F.coalesce(_lookup([(s, x) for s, _, x in SOURCES], source), source)


def category_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), name)


def excerpt(text: Column, most: int, suffix: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def cut_at_word(text: Column, most: int, suffix: str = "...") -> Column:
    """At most `most` characters, back to the last space."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), " [^ ]*$", ""), F.lit(suffix))).otherwise(text)


def quote(text: Column, most: int = 220) -> Column:
    """White space as single spaces, cut and right-trimmed."""
    flat = F.array_join(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), " ")
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.substring(flat, 1, most), r"(?U)\s+$", ""), F.lit("..."))).otherwise(flat)


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", F.lit("all")).otherwise(made)


@F.arrow_udf(T.StringType())
def unescaped(texts: pa.Array) -> pa.Array:
    """Named and numeric entities as the characters they stand for."""
    return pa.array([html.unescape(t) if t and "&" in t else t for t in texts.to_pylist()], pa.string())


def plain_text(markup: Column) -> Column:
    """Text of simple HTML: tags to spaces, white space collapsed, entities decoded, ends stripped."""
    return strip(unescaped(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"(?U)\s+", " ")))


def star_sentiment(rating: Column) -> Column:
    return F.when(rating >= 3.5, "positive").when(rating <= 2.5, "negative").when(rating.isNotNull(), "neutral")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def text_sentiment(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    score = compound(text, lexicon)
    return F.when(score > 0.3, "positive").when(score < -0.3, "negative").otherwise("neutral")


def sentiment(rating: Column, text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Stars decide where there are any, else the words."""
    return F.coalesce(star_sentiment(rating), text_sentiment(F.when(rating.isNull(), text), lexicon))


def embed_text(text: Column, most: int = 8000) -> Column:
    """Stripped text, a space if none is left, cut to what an embedding model takes."""
    clean = strip(F.coalesce(text, F.lit("")))
    return F.substring(F.when(clean == "", F.lit(" ")).otherwise(clean), 1, most)


_ISO = r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parsed_date(raw: Column) -> Column:
    """struct(month, year, instant) of an ISO date with optional time and offset, null for anything else.

    Month and year are those written, in the date's own offset; the instant counts no offset as UTC.
    Week dates (2024-W05-3) are not read. The text is matched once: its parts go through lambda variables.
    """
    mark = "\u0001"
    matched = F.regexp_replace(strip(raw), _ISO, mark + "$1|$3|$4|$5|$6|$7|$9")
    parts = F.transform(F.array(matched), lambda m: F.when(m.startswith(mark) & m.contains("|"), F.split(F.substring(m, 2, 100), r"\|")))

    def read(p: Column) -> Column:
        or_zero = lambda k: F.when(p[k] == "", "00").otherwise(p[k])
        offset = F.when(p[6].isin("", "Z"), "+00:00").when(F.length(p[6]) == 5, F.concat(F.substring(p[6], 1, 3), F.lit(":"), F.substring(p[6], 4, 2))).otherwise(p[6])
        day = F.concat_ws("-", p[0], p[1], p[2])
        instant = F.concat(day, F.lit("T"), or_zero(3), F.lit(":"), or_zero(4), F.lit(":"), or_zero(5), offset).try_cast("timestamp")
        return F.struct(F.substring(day, 1, 7).alias("month"), p[0].alias("year"), instant.alias("instant"))

    return F.get(F.filter(F.transform(parts, read), lambda d: d["instant"].isNotNull()), F.lit(0))


def health_score(positive: Column, neutral: Column, negative: Column, average: Column) -> Column:
    """0 to 100, rounded half to even; null without any sentiment."""
    n = positive + neutral + negative
    mix = 100 * (positive + 0.5 * neutral) / F.nullif(n, F.lit(0))
    blended = F.when(average.isNotNull(), 0.6 * mix + 0.4 * (100 * average / 5)).otherwise(mix)
    return F.bround(blended, 0).cast("int")


def health_label(score: Column) -> Column:
    return F.when(score.isNull(), "No data").when(score >= 80, "Excellent").when(score >= 65, "Good").when(score >= 45, "Mixed").otherwise("At risk")


def brand_words(name: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(GENERIC_BRAND_WORDS))


def flat_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def mentions(question: Column, brand: Column) -> Column:
    """Does the question name the brand, by its distinctive words or in full? Parts of words count."""
    asked = F.concat(F.lit(" "), flat_words(question), F.lit(" "))
    key, full = F.array_join(brand_words(brand), " "), flat_words(brand)
    return ((key != "") & F.contains(asked, key)) | ((full != "") & F.contains(asked, full))
