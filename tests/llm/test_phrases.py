"""Phrases and ranked search against plain versions, on odd documents and in small slices."""

import collections
import math
import random
import re

import pytest

from tests.llm.common_cases import documents, frame
from tidewater.llm import lexical, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, max_n, least, top):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    good = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in good.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731,B023
        if any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and inside(q) for (g, q), b in good.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, score, a, " ".join(p), left, right, total[lang]))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))
        ranked += [(lang, k, p, a, left, right, n, s) for k, (_, s, a, p, left, right, n) in enumerate(mine[:top], 1)]
    return sorted(ranked)


def odd_texts(seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "ÀB", "a b", "x\x00y", "\x1c", "日本", "don't", "-"]
    rows = []
    for i in range(260):
        n = rng.randrange(0, 40)
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n"]) for _ in range(n))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text + rng.choice(["", " New York City", " new york city hall"])))
    rows += [("en", None), (None, None), ("de", ""), ("en", " \t\n.,"), ("en", "tick tock " * 900), ("fr", "la la la " * 400)] + [rows[0]] * 30
    return rows


def phrase_frame(spark, rows):
    return spark.createDataFrame([(lang, text, "p", 1, 2, "s") for lang, text in rows], "lang string, text string, phrase string, n int, a int, score string").repartition(3)


@pytest.mark.parametrize("size", [phrases.SLICE, 50])
def test_phrases_equal_the_plain_version(spark, monkeypatch, size):
    rows = odd_texts()
    monkeypatch.setattr(phrases.slices, "__defaults__", (size,))
    for least, top in ((20, 2000), (3, 7)):
        got = phrases.collocations(phrase_frame(spark, rows), 5, least, top).collect()
        assert sorted(tuple(r) for r in got) == plain_phrases(rows, 5, least, top)


def test_slices_lose_no_word_and_count_none_twice():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb", " ", "  ", "\n", "ccc "]) for _ in range(rng.randrange(400))).encode()
        for size in (1, 2, 3):
            count = lambda parts: collections.Counter(
                tuple(w[i : i + size]) for part in parts for piece in part.split(b"\n") for w in [piece.split()] for i in range(len(w) - size + 1)  # noqa: B023
            )
            assert count(phrases.slices(text, size - 1, 16)) == count([text])


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = odd_texts(6)
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    got = phrases.collocations(phrase_frame(spark, rows), 4, 10, 2000).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 4, 10, 2000)


def test_products_beyond_64_bits_stay_exact(spark, monkeypatch):
    a, left, right, n = 3_000_000_019, 3_000_000_021, 3_000_000_023, 700_000_000_007
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, size int, a long")
    total = spark.createDataFrame([("en", n)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (counts, total))
    assert phrases.collocations(counts).first()["score"] == 1000 * a * n // (left * right)


def test_no_phrases(spark):
    for rows in ([], [(None, None)], [("en", "one")], [("en", "rare words here")]):
        assert phrases.collocations(phrase_frame(spark, rows)).count() == 0


def plain_search(docs, items, top):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    rows = [(i, collections.Counter(w), len(w)) for i, w in ((i, split(t)) for i, t in docs) if w]
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i] |= set(split(t))
    count, words, df = len(rows), sum(n for _, _, n in rows), collections.Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, wanted in terms.items():
        hits = []
        for doc, held, n in rows:
            m = 100 - 90 + (90 * n * count) // words
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * held[t]) // (1000 * held[t] + 8 * m)) for t in wanted & held.keys())
            if s > 0:
                hits.append((-s, doc is None, doc or 0, doc))
        out += [(item, k, h[3], -h[0]) for k, h in enumerate(sorted(hits)[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "alpha3 BRAVO7, charlie1 golf2?"), (2, "日本 é x"), (3, None), (4, ""), (5, "nowhere at all"), (1, "same line of words"), (None, "two words One"), (6, "alpha3 alpha3 ALPHA3"), (7, "repeats itself\x00line")]


@pytest.mark.parametrize(("range_pairs", "batch", "slice_bytes"), [(lexical.RANGE_PAIRS, lexical.SORTED, lexical.SLICE), (6, 40, 300)])
def test_search_equals_the_plain_version(spark, monkeypatch, range_pairs, batch, slice_bytes):
    monkeypatch.setattr(lexical, "SORTED", batch)
    monkeypatch.setattr(lexical, "SLICE", slice_bytes)
    docs = documents() + [(200 + i % 20, "same line of words") for i in range(60)]
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, rank int, term string")
    got = lexical.search(frame(spark, docs), items, 10, range_pairs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(docs, ITEMS, 10)


def test_ranges_hold_each_pair_once(spark):
    pairs = spark.createDataFrame([(i if i < 40 else None, f"t{k}") for i in range(42) for k in range(1 + i % 7)], "item_id long, term string").distinct()
    parts = [p.collect() for p in lexical.ranges(pairs, 20)]
    assert len(parts) > 3 and sorted(map(repr, sum(parts, []))) == sorted(map(repr, pairs.collect()))
    held = [{r.item_id for r in p} for p in parts]
    assert sum(map(len, held)) == 41 and max(map(len, parts)) <= 60


def test_radix_order_is_stable_and_sorted():
    import numpy as np

    rng = np.random.default_rng(3)
    for most in (10, 1 << 16, 1 << 17, 1 << 40):
        keys = rng.integers(0, most + 1, 5000)
        assert (lexical.radix_order(keys, most) == np.argsort(keys, kind="stable")).all()


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert lexical.search(frame(spark, []), items).count() == 0
    assert lexical.search(frame(spark), items.limit(0)).count() == 0
    assert lexical.search(frame(spark, [(1, None), (2, " ")]), items).count() == 0
