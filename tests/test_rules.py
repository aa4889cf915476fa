"""Literal edge cases of scalar rules, mappers and driver-side settings."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions.schema import content_key
from tidewater.operators import report
from tidewater.operators import reviews as R
from tidewater.sources import config, mappers, staging


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "source"),
    [
        ("https://www.reddit.com/r/x", "reddit"),
        ("https://notreddit.com.evil.com/", "web"),
        ("https://netflix.com/", "web"),
        ("https://reddit.com:443/x", "web"),
        ("", "web"),
        (None, "web"),
        ("https://m.youtube.com/watch", "youtube"),
    ],
)
def test_hosts(spark, url, source):
    assert one(spark, url, X.source_from_url) == source


@pytest.mark.parametrize(
    ("raw", "month"),
    [("2024-01-31T23:30:00-05:00", "2024-01"), ("2024-01-31T23:30:00Z", "2024-01"), ("2024-01-31", "2024-01"), ("20240131", "2024-01"), ("2024", None), ("6 years ago", None), ("", None), (None, None), ("2024-02-30", None), ("\t2024-05-05\n", "2024-05")],
)
def test_dates(spark, raw, month):
    got = one(spark, raw, X.parsed_date)
    assert (got and got.month) == month


def test_instant_counts_the_offset(spark):
    assert one(spark, "2024-01-31T23:30:00-05:00", lambda c: X.parsed_date(c)["instant"].cast("string")) == "2024-02-01 04:30:00"


@pytest.mark.parametrize(("stars", "label"), [(3.5, "positive"), (3.49, "neutral"), (2.5, "negative"), (2.51, "neutral"), (None, None)])
def test_stars(spark, stars, label):
    assert one(spark, stars, X.star_sentiment, "double") == label


def test_stars_beat_words(spark):
    row = spark.createDataFrame([(1.0, "great great great"), (None, "great great great"), (None, "table"), (None, None)], "r double, t string")
    assert [r[0] for r in row.select(X.sentiment(F.col("r"), F.col("t"))).collect()] == ["negative", "positive", "neutral", "neutral"]


@pytest.mark.parametrize(
    ("mix", "score", "label"),
    [((0, 0, 0, None), None, "No data"), ((45, 0, 55, None), 45, "Mixed"), ((65, 0, 35, None), 65, "Good"), ((80, 0, 20, None), 80, "Excellent"), ((1, 7, 0, None), 56, "Mixed"), ((1, 0, 0, 5.0), 100, "Excellent")],
)
def test_health(spark, mix, score, label):
    row = spark.createDataFrame([mix], "p int, u int, n int, a double").withColumn("h", X.health_score(*map(F.col, "puna")))
    assert row.select("h", X.health_label(F.col("h"))).first()[:] == (score, label)


def test_half_even(spark):
    row = spark.createDataFrame([(1, 3, 4)], "p int, u int, n int")  # 31.25
    assert row.select(X.health_score(F.col("p"), F.col("u"), F.col("n"), F.lit(None).cast("double"))).first()[0] == 31
    assert one(spark, 0, lambda c: F.bround(F.lit(2.5), 0).cast("int"), "int") == 2


@pytest.mark.parametrize(("n", "cut"), [(240, False), (241, True)])
def test_excerpts_count_characters(spark, n, cut):
    text = "😀" + "a" * (n - 1)
    assert one(spark, text, lambda c: X.excerpt(c, 240, "…")) == (text[:240] + "…" if cut else text)


def test_small_texts(spark):
    assert one(spark, " Blue Bottle, Coffee! ", X.slug) == "blue-bottle-coffee"
    assert one(spark, None, X.slug) == "all" and one(spark, "??", X.slug) == "all"
    assert one(spark, "<p>Fish &amp; chips</p>\n<br/> &lt;3", X.plain_text) == "Fish & chips <3"
    assert one(spark, "a  b\n c", X.quote) == "a b c"
    assert one(spark, "aa bb cc", lambda c: X.cut_at_word(c, 7)) == "aa bb..."
    assert one(spark, "https://www.amadeus.com/fr", X.bare_domain) == "amadeus.com"
    assert one(spark, "  ", X.embed_text) == " " and len(one(spark, "x" * 9000, X.embed_text)) == 8000
    assert one(spark, "1700000000", mappers.epoch_iso) == "2023-11-14T22:13:20+00:00" and one(spark, "x", mappers.epoch_iso) is None
    assert one(spark, "Blue Bottle", mappers.tag_of) == "bluebottle" and one(spark, "a b", mappers.tag_of) is None


def test_content_key_keeps_nulls_in_place(spark):
    import hashlib

    row = spark.createDataFrame([("b", "s", None, "t")], "a string, b string, c string, d string")
    assert row.select(content_key(*map(F.col, "abcd"))).first()[0] == hashlib.sha256(b"b|s|None|t").hexdigest()


def test_lenient_json(spark):
    assert one(spark, 'Sure: {"a": {"b": 1}} done', report.lenient_object) == '{"a": {"b": 1}}'
    assert one(spark, '{"a": 1}', report.lenient_object) == '{"a": 1}' and one(spark, "no", report.lenient_object) is None


def test_targets():
    brands = ["Blue Bottle Coffee", "Peets", "Acme"]
    assert config.resolve_targets("compare blue bottle and peets", "Acme", brands) == ["Blue Bottle Coffee", "Peets"]
    assert config.resolve_targets("how is it", "Acme", brands) == ["Acme"]
    assert config.resolve_targets("how is it", None, brands) == brands
    assert config.resolve_targets("how is it", None, None) == []
    assert config.resolve_targets("is coffee good", None, ["Coffee Co"]) == ["Coffee Co"]


def test_settings():
    assert [b["name"] for b in config.merge_brands([{"name": "A", "x": 1}], [{"name": " a "}, {"name": "B"}, {}])] == ["A", "B"]
    assert config.collection_plan(0) == ["free", "social", "broad", "paid"] and config.collection_plan(160) == ["free", "social"] and config.collection_plan(200) == ["free"]
    assert [config.run_status(*x) for x in ((1, 5), (0, 5), (0, 0))] == ["error", "ok", "empty"]
    assert config.clamp(0, 1, 200) == 1 and config.clamp(500, 1, 200) == 200


def test_staging(spark):
    assert staging.safe_table("reviews") == "staging.reviews"
    for bad in ("a;b", "a.b.c", "1x", "a b"):
        with pytest.raises(ValueError):
            staging.safe_table(bad)
    assert staging.read_staging(spark, "nothing_here") is None
    rows = spark.createDataFrame([('{"text": "a", "url": "u1"}', "2024-01-01"), ('{"text": "b", "url": "u2"}', "2024-01-02")], "_airbyte_data string, _airbyte_extracted_at string")
    got = staging.import_rows(staging.newest(rows, 1), "Acme", "partner", "normalized").collect()
    assert [(r.text, r.source) for r in got] == [("b", "partner")]
    with pytest.raises(ValueError):
        mappers.mapper("unknown")


def items(spark, *texts, **more):
    df = spark.createDataFrame([("Acme", t) for t in texts], "brand string, item string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_direct_mappers(spark):
    feed = '{"feed": {"entry": [{"im:rating": {"label": "4"}, "title": {"label": "T"}, "content": {"label": "C"}, "id": {"label": "9"}, "author": {"name": {"label": "N"}}, "updated": {"label": "2024-01-01T00:00:00-07:00"}}, {"title": {"label": "app"}}]}}'
    lone = '{"feed": {"entry": {"im:rating": {"label": "1"}, "title": {"label": "X"}, "id": {"label": "8"}}}}'
    got = sorted(mappers.app_store(items(spark, feed, lone, app_url="https://a/app")).collect(), key=lambda r: r.rating)
    assert [(r.text, r.rating) for r in got] == [("X", 1.0), ("T\n\nC", 4.0)] and got[1].source_url.endswith("?see-all=reviews#review-9")
    hit = '{"objectID": "1", "title": "A &amp; B", "comment_text": "<i>c</i>", "created_at_i": 1700000000, "author": "z"}'
    got = mappers.hackernews(items(spark, hit, hit)).collect()
    assert [(r.text, r.created_at) for r in got] == [("A &amp; B\n\n<i>c</i>", "2023-11-14T22:13:20+00:00")]
    post = '{"id": "p", "permalink": "/r/x/p", "title": "t", "selftext": "", "author": "[deleted]", "created_utc": 1700000000}'
    assert mappers.reddit_posts(items(spark, post, '{"id": "q"}')).first().author is None
    assert mappers.reddit_posts(items(spark, post), True).first().author == "[deleted]"
    assert mappers.google_play(items(spark, '{"content": " ok ", "reviewId": "r", "score": 5}', '{"content": " "}', app_url="https://p?id=a")).collect()[0].source_url == "https://p?id=a&reviewId=r"
    assert mappers.google_play(items(spark, '{"content": "x"}', app_url="https://p?id=a")).first().source_url == "https://p?id=a"
    bare = '{"feed": {"entry": {"im:rating": {"label": "2"}, "title": {"label": "Y"}}}}'
    assert mappers.app_store(items(spark, bare, app_id="5", country="us")).first().source_url == "https://apps.apple.com/us/app/id5?see-all=reviews"
    two = mappers.reddit_posts(items(spark, '{"permalink": "/a", "title": "t"}', '{"permalink": "/b", "title": " t "}', '{"permalink": "/b", "title": "t"}')).collect()
    assert sorted((r.source_url, r.text) for r in two) == [("https://www.reddit.com/a", "t"), ("https://www.reddit.com/b", "t")]
    assert mappers.mapper("reddit_api")(items(spark, '{"title": "t", "url": "https://elsewhere/"}')).first().source_url == "https://elsewhere/"
    assert mappers.mastodon(items(spark, '{"url": "https://m/1", "content": "<p>hi&nbsp;you</p>"}')).first().text == "hi\u00a0you"
    assert mappers.web_search(items(spark, '{"url": "https://x.com/1", "title": "t", "content": "c"}')).first().source == "twitter"
    assert mappers.web_pages(items(spark, '{"url": "https://b/", "markdown": "' + "word " * 600 + '"}')).first().text.endswith("word...")
    html = '<article class="c"><h2>Good</h2><p data-service-review-text-typography="true">Very <b>good</b></p><div data-service-review-rating="5"></div><a href="/reviews/77">x</a><time datetime="2024-01-01"></time></article><article><img alt="Rated 2 out of 5 stars"><h2>Bad</h2></article>'
    pages = spark.createDataFrame([("Acme", "https://t.com/review/acme", html)], "brand string, url string, html string")
    got = sorted(mappers.trustpilot(pages).collect(), key=lambda r: r.rating)
    assert [(r.text, r.rating, r.source_url) for r in got] == [("Bad", 2.0, "https://t.com/review/acme"), ("Good\n\nVery good", 5.0, "https://t.com/reviews/77")]


def test_drop_alert_equals_a_plain_count(spark):
    rng = random.Random(4)
    for n, brand in ((0, None), (25, None), (400, None), (400, "a")):
        rows = [(f"i{k:03d}", rng.choice(["A", "B"]), rng.choice(["negative", "positive", None]), True, "web", rng.choice([None, "2024-02-30", f"2024-03-{1 + k % 9:02d}"])) for k in range(n)]
        frame = spark.createDataFrame(rows, "id string, brand string, sentiment string, relevant boolean, source string, created_at string").repartition(5)
        got = tuple(R.drop_alert(frame, brand).first())
        dated = sorted((r for r in rows if r[5] and "-30" not in r[5] and (not brand or r[1].lower() == brand)), key=lambda r: r[0])
        dated = [r[2] == "negative" for r in sorted(dated, key=lambda r: r[5], reverse=True)]
        if len(dated) < 40:
            assert got == ("insufficient", None, None, None)
        else:
            pct = lambda x: round(100 * sum(x) / len(x))
            delta = pct(dated[:30]) - pct(dated[30:])
            assert got == ("drop" if delta >= 15 else "watch" if delta >= 7 else "ok", pct(dated[:30]), pct(dated[30:]), delta)


def test_connectors():
    active = {c["key"] for c in config.connectors({"apify"}) if c["status"] == "active"}
    assert {"web", "app_store", "yelp", "mastodon"} <= active and not active & {"firecrawl", "reddit", "trustpilot"} and len(config.connectors(set())) == 13
