"""Small documents with every odd case: nulls, empty and long texts, copies, repeats, clashing columns."""

import random

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike", "november", "oscar", "papa", "quebec", "romeo", "sierra", "tango", "uniform", "victor", "whiskey", "xray", "yankee", "zulu"]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
    for i in range(12, n, 13):
        words[i] += ".\n"
    return " ".join(words).replace("\n ", "\n")


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    return " ".join(rng.choice(WORDS) + "x" if rng.random() < share else w for w in words)


def documents(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    shared = prose(rng, 80).replace("\n", " ")
    rows = [(i, prose(rng, rng.randrange(5, 160))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(6)]
    rows += [(46 + i, edited(rng, rows[20 + i][1], 0.03)) for i in range(8)]
    rows += [(54 + i, prose(rng, 30) + " " + shared + " " + prose(rng, 30)) for i in range(5)]
    rows += [(60, None), (61, ""), (62, "   \n\t "), (63, "one"), (64, "ONE"), (65, "two words"), (66, "日本 語 é x <|endoftext|> ok"), (None, prose(rng, 60)), (None, None)]
    rows += [(67, prose(rng, 6000)), (68, "same line of words that repeats itself\n" * 40), (3, rows[3][1]), (3, rows[3][1])]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, key string, line string, label int, sequence_id long"


def frame(spark, rows=None):
    """Extra columns have names that operators use themselves."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "r", 1, "k", "l", 0, 9) for i, t in rows], SCHEMA).repartition(3)
