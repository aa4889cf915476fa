"""Vectors of words by the company they keep."""

import random

import numpy as np

from tidewater.operators import enrich, meaning


def corpus(spark, n=900):
    rng = random.Random(11)
    places = {"drink": (["coffee", "espresso"], ["brewed", "roasted", "cup", "beans", "barista", "crema"]), "ride": (["bicycle", "bike"], ["wheels", "pedal", "chain", "saddle", "brakes", "gears"]), "sky": (["rain", "drizzle"], ["clouds", "umbrella", "puddles", "forecast", "storm", "wet"])}
    rows = []
    for _ in range(n):
        twins, company = places[rng.choice(list(places))]
        words = [rng.choice(company) for _ in range(8)]
        words[rng.randrange(8)] = rng.choice(twins)  # the twins never stand together
        rows.append((" ".join(w if rng.random() < 0.8 else rng.choice(["the", "and", "very"]) for w in words),))
    return spark.createDataFrame(rows + [(None,), ("",)], "text string"), places


def test_synonyms_are_neighbours(spark):
    docs, places = corpus(spark)
    model = meaning.fit(docs, 12)
    for twins, company in places.values():
        near = model.nearest(twins[0], 8)
        assert twins[1] in near and set(near[:5]) <= {*twins, *company}
    embed = model.embedder()
    a, b, c, d = embed(["roasted coffee beans", "brewed espresso crema", "bike saddle", "zzz unknown"])
    assert a @ b > 0.8 and a @ c < 0.4 and abs(np.linalg.norm(d) - 1) < 1e-5
    rows = spark.createDataFrame([("1", "espresso cup"), ("2", None)], "id string, text string")
    got = {r.id: r.embedding for r in enrich.embed(rows, embed).collect()}
    assert len(got["1"]) == 12 == len(got["2"])


def test_no_words(spark):
    model = meaning.fit(spark.createDataFrame([], "text string"), 8)
    assert model.words == {} and model.embedder()(["x"]).shape == (1, 8)
