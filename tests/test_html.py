"""Cards in HTML, entities, and sentiment by rules."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions import valence
from tidewater.sources import html, mappers


def cards(spark, pages, card, fields):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page_id int, html string")
    return sorted(map(tuple, html.cards(rows, card, fields, ["page_id"]).collect()), key=repr)


def test_selectors_nesting_and_broken_markup(spark):
    pages = [
        '<div class="card a">one <b>two</b><div class="card b"> three</div></div><p>x',
        '<article data-x>never <i>closed',
        '</div><img alt="Rated 4"><article data-x="1"><p>a<p>b<li>c<li>d</article>',
        None, "", "no markup",
    ]
    assert cards(spark, pages, '[class*="card"]', {"bold": (["b"], None), "inner": (['div[class*="b"]'], None)}) == [(0, "two", "three"), (0, None, None)]
    assert cards(spark, pages, "article[data-x]", {"p": (["h9", "p"], None), "i": (["i"], None)}) == [(1, None, "closed"), (2, "a", None)]
    page = html.Page(pages[2])
    assert [page.text(e) for e in page.elements if e.tag == "li"] == ["c", "d"] and [e.attrs for e in page.elements if e.tag == "img"] == [{"alt": "Rated 4"}]
    for bad in ("a b", "div > p", "", "a:hover"):
        with pytest.raises(ValueError):
            html.selector(bad)


def test_review_cards(spark):
    page = (
        '<article data-service-review-card-paper><a data-review-title-typography href="/reviews/9"><h2>Fine &amp; good</h2></a><span data-consumer-name-typography> Al </span>'
        '<div data-service-review-rating="x"></div><img alt="Rated 4.5 out of 5 stars"><p data-service-review-text-typography>Body</p><time datetime="2024-05-05T00:00:00Z"></time></article>'
        '<div class="styles_reviewCard__z"><p class="reviewText">no link</p></div><article data-service-review-card-paper><b>nothing</b></article>'
    )
    pages = spark.createDataFrame([("Acme", page), ("Acme", None)], "brand string, html string")
    got = sorted(map(tuple, mappers.trustpilot(pages).select("source_url", "author", "rating", "text", "created_at", "extra").collect()))
    assert got == [("", None, None, "no link", None, '{"site":"trustpilot"}'), ("https://www.trustpilot.com/reviews/9", "Al", 4.5, "Fine & good\n\nBody", "2024-05-05T00:00:00Z", '{"site":"trustpilot"}')]


def test_entities(spark):
    rows = spark.createDataFrame([("<p>&eacute;t&#233; &#x1F600; &amp;lt; &nbsp;x&hellip;</p>",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.plain_text(F.col("t"))).collect()] == ["été 😀 &lt; \xa0x…", None]


LEXICON = {"good": 2.0, "bad": -2.0}


def test_each_rule_of_valence():
    score = lambda t: round(valence.score_of(t, LEXICON), 6)
    assert score("") == score("plain words") == 0.0
    assert score("good") == 2.0 and score("Good bad good") == 2.0
    assert score("very good") == 2.293 and score("very bad") == -2.293 and score("hardly good") == 1.707
    assert score("very x good") == round(2 + 0.293 * 0.95, 6) and score("very x y good") == round(2 + 0.293 * 0.9, 6) and score("very x y z good") == 2.0
    assert score("not good") == -1.48 and score("not x y good") == -1.48 and score("not x y z good") == 2.0 and score("don't bad") == 1.48
    assert score("GOOD x") == 2.733 and score("GOOD X") == 2.0
    assert score("good but bad") == -2.0 and score("but good") == 3.0
    assert score("good!!") == 2.584 and score("bad!!!!!!") == round(-2 - 4 * 0.292, 6) and score("good??") == 2.36 and score("good????") == 2.96 and score("!!!") == 0.0


def test_forms_of_words():
    words = valence.own_lexicon()
    for form in ("loved", "loves", "loving", "happily", "happier", "nicest", "terribly", "tastier", "worries", "worried", "worrying", "crashes", "idiots", "lied"):
        assert form in words, form
    assert len(words) > 400 and all(-4 <= v <= 4 for v in words.values())


def test_lexicons_as_tables(spark):
    table = spark.createDataFrame([("Good", 2.0), ("good", 1.0), (None, 3.0), ("x", None)], "word string, valence double")
    assert valence.read_lexicon(table) == {"good": 1.5}
    docs = spark.createDataFrame([(k, "fine day" if k % 2 else "awful day") for k in range(20)] + [(99, "fine"), (1, "fine day")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] * 3 + [(99, 0), (99, 1), (None, 1), (5, 7)], "doc_id long, good int")
    got = {r.word: (r.valence, r.n) for r in valence.learn(docs, labels).collect()}
    assert got["fine"][0] > 2 and got["awful"][0] < -2 and abs(got["day"][0]) < 0.3 and got["fine"][1] == 10
    with pytest.raises(ValueError):
        valence.compound(None, dict.fromkeys(map(str, range(valence.MOST_WORDS + 1)), 1.0))
