"""From items of many shapes, as JSON text, to the one record. A mapper is a projection; nothing is inferred.

Every mapper takes a DataFrame with a JSON column `item` and a `brand` column and returns RAW_SCHEMA
without captured_at. Items without link or visible text are dropped; malformed JSON gives nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.schema import content_key
from tidewater.functions.text import cut_at_word, join_parts, plain_text, source_from_url, strip, to_rating
from tidewater.sources import html


def field(path: str, item: str = "item") -> Column:
    return F.get_json_object(item, f"${path}" if path.startswith("[") else f"$.{path}")


def any_text(*paths: str) -> Column:
    """The first of the fields that is neither missing, empty, false nor zero."""
    truthy = lambda c: F.when(~c.isin("", "false", "[]", "{}") & ~F.coalesce(c.try_cast("double") == 0, F.lit(False)), c)
    return F.coalesce(*[truthy(field(p)) for p in paths[:-1]], field(paths[-1]))


def is_object(path: str) -> Column:
    return F.coalesce(F.startswith(F.ltrim(field(path)), F.lit("{")), F.lit(False))


def extra(**paths: str) -> Column:
    return F.to_json(F.struct(*[field(p).alias(k) for k, p in paths.items()]))


def record(items: DataFrame, source: Column, url: Column, text: Column, author: Column, rating: Column, created_at: Column, more: Column, need_url: bool = True) -> DataFrame:
    empty = F.lit("")
    rows = items.select(
        "brand",
        source.alias("source"),
        F.coalesce(url, empty).alias("source_url"),
        author.alias("author"),
        rating.cast("double").alias("rating"),
        text.alias("text"),
        created_at.alias("created_at"),
        more.alias("extra"),
    ).where(strip(F.col("text")) != "")
    rows = rows.where("source_url <> ''") if need_url else rows
    key = content_key(F.col("brand"), F.col("source"), F.col("source_url"), F.col("text"))
    return rows.select(key.alias("id"), *rows.columns)


def nothing() -> Column:
    return F.lit(None)


def google_maps(items: DataFrame) -> DataFrame:
    return record(
        items, F.lit("google_maps"), any_text("reviewUrl", "url"), any_text("text", "reviewText"), any_text("name", "reviewerName"),
        to_rating(any_text("stars", "rating")), any_text("publishedAtDate", "publishAt"), F.to_json(F.struct(any_text("title", "placeName").alias("place"))),
    )


def yelp(items: DataFrame) -> DataFrame:
    return record(items, F.lit("yelp"), any_text("url", "reviewUrl"), any_text("text", "comment"), any_text("userName", "author"), to_rating(any_text("rating", "stars")), field("date"), extra(business="bizName"))


def tripadvisor(items: DataFrame) -> DataFrame:
    author = F.when(is_object("user"), field("user.username")).otherwise(field("userName"))
    return record(items, F.lit("tripadvisor"), field("url"), any_text("text", "review"), author, to_rating(field("rating")), field("publishedDate"), extra(place="placeName"))


def reddit(items: DataFrame) -> DataFrame:
    more = F.to_json(F.struct(any_text("communityName", "parsedCommunityName").alias("subreddit"), field("upVotes").alias("up_votes"), field("numberOfComments").alias("num_comments"), field("dataType").alias("data_type")))
    return record(items, F.lit("reddit"), any_text("url", "link"), join_parts(field("title"), any_text("body", "text")), any_text("username", "author"), nothing(), field("createdAt"), more)


def instagram(items: DataFrame) -> DataFrame:
    more = F.to_json(F.struct(field("likesCount").alias("likes"), field("commentsCount").alias("comments"), any_text("hashtag", "inputUrl").alias("hashtag"), field("type").alias("type")))
    return record(items, F.lit("instagram"), any_text("url", "postUrl"), any_text("caption", "text"), any_text("ownerUsername", "ownerFullName"), nothing(), any_text("timestamp", "takenAtDate"), more)


def facebook(items: DataFrame) -> DataFrame:
    named = any_text("authorName", "pageName")
    author = F.when(F.coalesce(named, F.lit("")) != "", named).when(is_object("user"), field("user.name")).otherwise(named)
    return record(
        items, F.lit("facebook"), any_text("url", "postUrl", "topLevelUrl"), any_text("text", "message", "postText"), author, nothing(),
        any_text("time", "date", "timestamp"), extra(likes="likes", comments="comments", shares="shares"),
    )


def web(items: DataFrame) -> DataFrame:
    """Search results: a page of results gives a row for each, anything else counts as one result."""
    results = F.from_json(field("organicResults"), "array<string>")
    rows = items.select("brand", F.explode(F.coalesce(results, F.array("item"))).alias("item")).where(F.ltrim("item").startswith("{"))
    title, about = strip(F.coalesce(field("title"), F.lit(""))), strip(F.coalesce(field("description"), F.lit("")))
    more = extra(position="position", website_title="websiteTitle", displayed_url="displayedUrl", number_of_reviews="numberOfReviews", last_updated="lastUpdated")
    text = strip(F.concat(title, F.when(about != "", F.concat(F.lit("\n\n"), about)).otherwise("")))
    return record(rows, source_from_url(field("url")), field("url"), text, field("websiteTitle"), to_rating(field("averageRating")), field("date"), more)


def normalized(items: DataFrame) -> DataFrame:
    """Items that already have about the record's fields; `source` is a column, all other fields go to extra."""
    known = ["text", "source_url", "url", "author", "rating"]
    rest = F.map_filter(F.from_json("item", "map<string,string>"), lambda k, v: ~k.isin(known) & ~k.startswith("_airbyte_"))
    return record(
        items, F.col("source"), any_text("source_url", "url", "reviewUrl", "link"), any_text("text", "review", "body", "description"),
        any_text("author", "name", "userName"), to_rating(any_text("rating", "stars")), any_text("created_at", "createdAt", "date"), F.to_json(rest),
    )


# ---- items of the sources that are read directly


def beside(items: DataFrame, name: str) -> Column:
    """A column of the items, null if there is none."""
    return F.col(name) if name in items.columns else F.lit(None).cast("string")


def part(path: str) -> Column:
    """A field without white space at its ends; missing or empty ones are left out when parts are joined."""
    return strip(F.coalesce(field(path), F.lit("")))


def app_store(items: DataFrame) -> DataFrame:
    """A feed page: `feed.entry` is a list or one entry, whose values lie under `label`.

    `app_url` is a column; without one, `app_id` and `country` make the link. An entry without id links to all reviews.
    """
    entries = F.when(field("feed.entry").startswith("{"), F.array(field("feed.entry"))).otherwise(F.from_json(field("feed.entry"), "array<string>"))
    names = ("app_url", "app_id", "app_name", "country")
    rows = items.select("brand", *[beside(items, c).alias(c) for c in names], F.explode(entries).alias("item"))
    rating = field("['im:rating'].label")
    rows = rows.where(field("['im:rating']").isNotNull())
    made = F.concat(F.lit("https://apps.apple.com/"), F.col("country"), F.lit("/app/id"), F.col("app_id"))
    anchor = F.coalesce(F.concat(F.lit("#review-"), F.nullif(field("id.label"), F.lit(""))), F.lit(""))
    url = F.concat(F.coalesce(F.nullif("app_url", F.lit("")), made), F.lit("?see-all=reviews"), anchor)
    link = F.coalesce(field("link.attributes.href"), field("link[0].attributes.href"))
    more = F.to_json(F.struct("app_id", "app_name", "country", field("id.label").alias("review_id"), field("['im:version'].label").alias("version"), link.alias("apple_review_link")))
    return record(rows, F.lit("app_store"), url, strip(join_parts(field("title.label"), field("content.label"))), field("author.name.label"), to_rating(rating), field("updated.label"), more)


def google_play(items: DataFrame) -> DataFrame:
    """Reviews of an app; `app_url` and `package` are columns. A review without id links to the app."""
    anchor = F.coalesce(F.concat(F.lit("&reviewId="), F.nullif(field("reviewId"), F.lit(""))), F.lit(""))
    more = F.to_json(F.struct(
        beside(items, "package").alias("package"), F.coalesce(field("reviewId"), F.lit("")).alias("review_id"), field("thumbsUpCount").alias("thumbs_up"),
        any_text("reviewCreatedVersion", "appVersion").alias("app_version"), field("replyContent").alias("reply"),
    ))
    return record(items, F.lit("google_play"), F.concat(F.col("app_url"), anchor), part("content"), field("userName"), to_rating(field("score")), field("at"), more)


def hackernews(items: DataFrame) -> DataFrame:
    """Stories and comments, markup as it is; a hit that comes again counts once."""
    at = F.coalesce(epoch_iso(field("created_at_i")), field("created_at"))
    url = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.nullif(field("objectID"), F.lit("")))
    more = F.to_json(F.struct(field("points").alias("points"), F.lit("hn_algolia").alias("engine")))
    return record(items, F.lit("hackernews"), url, join_parts(part("title"), part("story_text"), part("comment_text")), field("author"), nothing(), at, more).dropDuplicates(["id"])


def mastodon(items: DataFrame) -> DataFrame:
    return record(items, F.lit("mastodon"), any_text("url", "uri"), plain_text(field("content")), field("account.acct"), nothing(), field("created_at"), F.to_json(F.struct(field("favourites_count").alias("favourites"), field("reblogs_count").alias("reblogs"), F.lit("mastodon_tag").alias("engine"))))


def tag_of(keyword: Column) -> Column:
    """Hashtag of a keyword; null below three characters."""
    tag = F.lower(F.regexp_replace(keyword, r"[^\p{L}\p{N}]", ""))
    return F.when(F.length(tag) >= 3, tag)


def epoch_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds.try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def reddit_posts(items: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """Posts of the public listing, or, with keep_deleted, of the official interface.

    The listing's posts need a permalink, deleted authors become null and a post that comes again counts once;
    the interface's posts fall back to their `url` and stay as they are.
    """
    text, at = join_parts(part("title"), part("selftext")), epoch_iso(field("created_utc"))
    link = F.concat(F.lit("https://www.reddit.com"), F.nullif(field("permalink"), F.lit("")))
    if keep_deleted:
        return record(items, F.lit("reddit"), F.coalesce(link, field("url")), text, field("author"), nothing(), at, extra(subreddit="subreddit", up_votes="ups", num_comments="num_comments", over_18="over_18"))
    author = F.when(~field("author").isin("", "[deleted]"), field("author"))
    more = F.to_json(F.struct(*[field(c).alias(c) for c in ("subreddit", "score", "num_comments")], F.lit("reddit_json").alias("engine")))
    return record(items, F.lit("reddit"), link, text, author, nothing(), at, more).dropDuplicates(["id"])


def web_search(items: DataFrame) -> DataFrame:
    """Results of a search service: title and content, tagged by host, never rated."""
    text = join_parts(strip(F.coalesce(field("title"), F.lit(""))), strip(F.coalesce(field("content"), F.lit(""))))
    return record(items, source_from_url(field("url")), field("url"), text, nothing(), nothing(), field("published_date"), F.to_json(F.struct(field("score").alias("score"), F.lit("tavily").alias("engine"))))


def web_pages(items: DataFrame, most: int = 2000) -> DataFrame:
    """Pages as text, cut at a word."""
    body = cut_at_word(strip(F.coalesce(any_text("markdown", "description"), F.lit(""))), most)
    return record(items, source_from_url(field("url")), field("url"), join_parts(strip(F.coalesce(field("title"), F.lit(""))), body), nothing(), nothing(), nothing(), F.to_json(F.struct(F.lit("firecrawl").alias("engine"))))


# Where the parts of a review card lie.
CARD = 'article[data-service-review-card-paper], article[class*="reviewCard"], [class*="styles_reviewCard"], article'
CARD_FIELDS = {
    "title": (["[data-review-title-typography]", 'a[class*="reviewTitle"]', "h2"], None),
    "body": (["[data-service-review-text-typography]", 'p[class*="reviewContent"]', 'p[class*="reviewText"]'], None),
    "author": (["[data-consumer-name-typography]", 'span[class*="consumerName"]'], None),
    "stars": (["[data-service-review-rating]"], "data-service-review-rating"),
    "stars_text": (["img[alt*='Rated'], img[alt*='rated']"], "alt"),
    "created": (["time"], "datetime"),
    "link": (['a[href*="/reviews/"], a[data-review-title-typography]'], "href"),
}
CARD_SITE = "https://www.trustpilot.com"


def trustpilot(pages: DataFrame) -> DataFrame:
    """Review cards in HTML (columns brand, html and, if known, the page's url): rating from an attribute or the image's words.

    Links are made absolute; a card without link has the page's, or an empty one. A card without title and body is dropped.
    """
    pages = pages.withColumn("url", beside(pages, "url"))
    rows = html.cards(pages, CARD, CARD_FIELDS, ["brand", "url"])
    link, empty = F.col("link"), F.lit("")
    site = F.coalesce(F.nullif(F.regexp_extract("url", r"^(https?://[^/]+)", 1), empty), F.lit(CARD_SITE))
    absolute = F.when(F.coalesce(link, empty) == "", F.coalesce("url", empty)).when(link.startswith("http"), link).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(site, F.lit("/"), link))
    worded = F.regexp_extract("stars_text", r"([0-5](?:\.\d)?)\s+out of\s+5", 1)
    stars = F.coalesce(to_rating(F.col("stars")), to_rating(worded))
    some = lambda c: F.nullif(F.col(c), empty)
    return record(rows, F.lit("trustpilot"), absolute, join_parts(F.col("title"), F.col("body")), some("author"), stars, some("created"), F.to_json(F.struct(F.lit("trustpilot").alias("site"))), need_url=False)


MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "google_maps": google_maps,
    "yelp": yelp,
    "reddit": reddit,
    "tripadvisor": tripadvisor,
    "instagram": instagram,
    "facebook": facebook,
    "web": web,
    "normalized": normalized,
}

DIRECT: dict[str, Callable[[DataFrame], DataFrame]] = {
    "app_store": app_store,
    "google_play": google_play,
    "hackernews": hackernews,
    "mastodon": mastodon,
    "reddit_json": reddit_posts,
    "reddit_api": lambda items: reddit_posts(items, keep_deleted=True),
    "web_search": web_search,
    "web_pages": web_pages,
    "trustpilot": trustpilot,
}


def mapper(name: str | None, source: str | None = None) -> Callable[[DataFrame], DataFrame]:
    key = (name or source or "normalized").strip().lower()
    if key not in MAPPERS | DIRECT:
        raise ValueError(f"unknown mapper: {key}")
    return (MAPPERS | DIRECT)[key]
