"""How positive a text sounds, by rules over a lexicon: each known word has a valence, and its surroundings change it.

The rules are those of rule-based sentiment models (Hutto and Gilbert 2014): degree words before a word
strengthen or weaken it, a negation within three words turns it, capitals among other words stress it, what
follows a "but" weighs more than what precedes it, and marks at the end add emphasis. The lexicon is a
table (word, valence); the one given here is small, of our own, and made from stems by a rule.

Cases: null and empty texts score 0; words outside the lexicon count nothing; a word that is in the lexicon is no degree
word; equal words count each time.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_']+"
#: Weights of the rules.
DEGREE, FADE, TURN, STRESS = 0.293, (1.0, 0.95, 0.9), -0.74, 0.733
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAIM, MOST_EXCLAIM, ASK, MANY_ASK = 0.292, 4, 0.18, 0.96
SCALE = 15.0
#: A lexicon with more words than this is refused: every task holds it.
MOST_WORDS = 500_000

#: Words that strengthen (1) or weaken (-1) the word after them.
DEGREES = {
    **dict.fromkeys(
        "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fully greatly hugely "
        "incredibly intensely more most particularly purely quite really remarkably so substantially thoroughly totally truly unbelievably utterly very".split(),
        1,
    ),
    **dict.fromkeys("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split(), -1),
}
NEGATIONS = frozenset(
    "ain't aint aren't can't cannot cant couldn't despite didn't doesn't don't dont hadn't hasn't haven't isn't mustn't needn't neither never no nobody none nope nor not "
    "nothing nowhere rarely seldom shouldn't wasn't weren't without won't wouldn't".split()
)

#: Stems of our own with valence from -4 to 4: verbs, qualities and things take different endings.
STEMS = {
    "verb": {
        "abuse": -3.0, "adore": 2.9, "annoy": -1.8, "appreciate": 2.1, "attack": -2.1, "blame": -1.6, "break": -1.4, "cheat": -2.4, "complain": -1.5, "crash": -1.8, "delight": 2.6,
        "disappoint": -2.1, "dislike": -1.7, "enjoy": 2.2, "fail": -2.2, "hate": -2.7, "help": 1.7, "hurt": -2.0, "ignore": -1.4, "impress": 2.2, "insult": -2.3, "lie": -1.8, "like": 1.5,
        "love": 3.1, "overcharge": -1.9, "please": 1.6, "praise": 2.3, "recommend": 1.9, "refuse": -1.3, "regret": -1.8, "ruin": -2.6, "smile": 1.5, "steal": -2.3, "suffer": -2.2, "thank": 1.6,
        "threaten": -2.3, "thrill": 2.4, "trust": 2.0, "waste": -2.0, "welcome": 1.8, "win": 2.1, "worry": -1.6, "destroy": -2.7, "kill": -3.2, "despise": -2.8,
    },
    "quality": {
        "amazing": 3.0, "angry": -2.2, "awesome": 3.1, "awful": -2.9, "bad": -2.5, "beautiful": 2.8, "boring": -1.5, "brilliant": 2.8, "broken": -1.9, "careless": -1.7, "cheap": -0.8, "clean": 1.5,
        "clear": 1.1, "cold": -0.6, "comfortable": 1.8, "cruel": -2.8, "damaged": -1.9, "delicious": 2.7, "dirty": -1.9, "dishonest": -2.5, "dreadful": -2.6, "dumb": -2.2, "easy": 1.4, "efficient": 1.7,
        "evil": -3.2, "excellent": 3.0, "expensive": -1.0, "fair": 1.4, "fantastic": 2.9, "fast": 1.3, "faulty": -1.8, "fine": 0.9, "fresh": 1.4, "friendly": 2.2, "generous": 2.2, "good": 1.9, "great": 3.0,
        "happy": 2.6, "helpful": 1.9, "honest": 2.2, "horrible": -2.7, "ideal": 2.2, "late": -1.0, "lousy": -2.3, "lovely": 2.7, "nasty": -2.5, "nice": 1.9, "noisy": -1.1, "overpriced": -1.7, "pathetic": -2.5,
        "perfect": 2.8, "pleasant": 2.2, "polite": 1.9, "poor": -1.9, "reliable": 2.0, "rotten": -2.3, "rude": -2.1, "sad": -2.0, "safe": 1.6, "slow": -1.3, "stupid": -2.5, "superb": 2.9, "tasty": 2.1,
        "terrible": -2.6, "terrific": 2.6, "ugly": -2.2, "unhelpful": -1.8, "unsafe": -2.0, "useful": 1.8, "useless": -1.9, "vile": -2.9, "wonderful": 2.8, "worthless": -2.3, "wrong": -1.7,
    },
    "thing": {
        "bargain": 1.3, "bliss": 2.7, "bug": -1.2, "complaint": -1.5, "defect": -1.7, "delay": -1.3, "disaster": -2.9, "error": -1.5, "failure": -2.3, "fool": -1.9, "fraud": -2.8, "garbage": -2.1, "gem": 1.9,
        "idiot": -2.5, "joke": -0.9, "joy": 2.7, "mess": -1.6, "mistake": -1.5, "moron": -2.7, "nightmare": -2.5, "pleasure": 2.4, "problem": -1.6, "rip": -1.2, "scam": -2.7, "scum": -3.0, "success": 2.5,
        "thief": -2.4, "trash": -2.0, "treat": 1.7, "vermin": -2.6, "victory": 2.4,
    },
}
#: Words with no regular forms.
SINGLE = {"best": 3.2, "better": 1.9, "worse": -2.1, "worst": -3.1, "won": 2.1, "broke": -1.4, "stole": -2.3, "stolen": -2.3, "lied": -1.8, "lying": -1.9, "thieves": -2.4}


def _ending(stem: str, ending: str) -> str:
    """A stem with an ending of English: silent e, y after a consonant, and hissing sounds change it."""
    consonant_y = stem.endswith("y") and stem[-2] not in "aeiou"
    if ending == "s":
        return stem[:-1] + "ies" if consonant_y else stem + ("es" if stem.endswith(("s", "x", "z", "ch", "sh")) else "s")
    if ending == "ly":
        return stem[:-1] + "ily" if consonant_y else stem[:-1] + "y" if stem.endswith("le") else stem + "ly"
    if stem.endswith("e") and ending[0] in "ei":
        return stem[:-1] + ending
    return stem[:-1] + "i" + ending if consonant_y and ending != "ing" else stem + ending


def own_lexicon() -> dict[str, float]:
    endings = {"verb": ("s", "ed", "ing"), "quality": ("ly", "er", "est"), "thing": ("s",)}
    made = {form: v for kind, stems in STEMS.items() for stem, v in stems.items() for form in (_ending(stem, e) for e in endings[kind])}
    return made | {stem: v for stems in STEMS.values() for stem, v in stems.items()} | SINGLE


def _capital(word: str) -> bool:
    return word == word.upper() and word != word.lower()


def score_of(text: str, lexicon: dict[str, float]) -> float:
    """The summed valence of a text after all rules."""
    words = regex.findall(WORD, text)
    low = [w.lower() for w in words]
    hits = [i for i, w in enumerate(low) if w in lexicon]
    if not hits:
        return 0.0
    capitals = sum(map(_capital, words))
    mixed = 0 < capitals < len(words)
    but = low.index("but") if "but" in low else None
    total = 0.0
    for i in hits:
        v = lexicon[low[i]]
        sign = 1.0 if v > 0 else -1.0
        if mixed and _capital(words[i]):
            v += sign * STRESS
        turned = False
        for back, fade in enumerate(FADE, 1):
            if i < back:
                break
            word = low[i - back]
            if word in DEGREES and word not in lexicon:
                v += sign * DEGREES[word] * DEGREE * fade
            turned = turned or word in NEGATIONS
        if turned:
            v *= TURN
        if but is not None and i != but:
            v *= BEFORE_BUT if i < but else AFTER_BUT
        total += v
    asks = text.count("?")
    marks = min(text.count("!"), MOST_EXCLAIM) * EXCLAIM + (0 if asks < 2 else ASK * asks if asks <= 3 else MANY_ASK)
    return total + marks if total > 0 else total - marks if total < 0 else total


def compound(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """The score of a text between -1 and 1. Texts stay where they are: nothing is shuffled."""
    words = own_lexicon() if lexicon is None else lexicon
    if len(words) > MOST_WORDS:
        raise ValueError(f"a lexicon of {len(words)} words is too large to hold in every task")

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        sums = [score_of(t, words) if t else 0.0 for t in texts.to_pylist()]
        return pa.array([x / math.sqrt(x * x + SCALE) for x in sums], pa.float64())

    return score(text)


def read_lexicon(table: DataFrame) -> dict[str, float]:
    """A table (word, valence) as a lexicon; of a word that repeats the mean counts. Its size is checked first."""
    rows = table.where("word is not null and valence is not null").groupBy(F.lower("word").alias("word")).agg(F.avg("valence").alias("valence"))
    if rows.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError(f"a lexicon of over {MOST_WORDS} words is too large to hold in every task")
    return {r["word"]: r["valence"] for r in rows.collect()}


def learn(docs: DataFrame, labels: DataFrame, least: int = 5, scale: float = 1.0, most: float = 4.0) -> DataFrame:
    """A lexicon (word, valence, n) from texts with a good (1) or bad (0) mark: the log odds of a word among the good.

    Each document counts a word once; half a document is added to each side. Rows of labels that repeat count once; a
    document with both marks counts for neither.
    """
    marked = labels.where("good in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("_top")).where("good = _top").drop("_top")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text").distinct().join(marked, "doc_id").select("good", F.explode(words).alias("word"))
    sides = marked.join(docs.select("doc_id", "text").distinct(), "doc_id").agg(F.sum("good").alias("goods"), F.count("*").alias("all"))
    counts = rows.groupBy("word").agg(F.sum("good").alias("g"), F.count("*").alias("n")).where(F.col("n") >= least)
    odds = F.log((F.col("g") + 0.5) / (F.col("goods") - F.col("g") + 0.5)) - F.log((F.col("n") - F.col("g") + 0.5) / (F.col("all") - F.col("goods") - F.col("n") + F.col("g") + 0.5))
    made = counts.crossJoin(sides)  # one row
    return made.select("word", F.round(F.greatest(F.lit(-most), F.least(F.lit(most), scale * odds)), 6).alias("valence"), "n")
