"""Driver-side settings: brands, connectors, target resolution. No data passes through here."""

from __future__ import annotations

import os
import re

from tidewater.functions.taxonomy import GENERIC_BRAND_WORDS


def merge_brands(*documents: list[dict]) -> list[dict]:
    """Brand entries of several files; names are equal regardless of case and the first file wins."""
    seen: set[str] = set()
    merged = []
    for entry in (e for d in documents for e in d or []):
        key = str(entry.get("name", "")).strip().lower()
        if key and key not in seen:
            seen.add(key)
            merged.append(entry)
    return merged


def read_brands(path: str) -> list[dict]:
    """`brands:` of a YAML file; needs a YAML library, which is optional."""
    import yaml

    if not os.path.exists(path):
        return []
    with open(path) as f:
        return (yaml.safe_load(f) or {}).get("brands") or []


def collection_plan(have: int, target: int = 200, floor: int = 150) -> list[str]:
    """Stages still to run: free sources first, social ones below the target, broad and paid ones below the floor."""
    stages = ["free"]
    if have < target:
        stages.append("social")
    if have < floor:
        stages += ["broad", "paid"]
    return stages


# Connectors in the order of the list, their labels and categories, and the credentials of which one is enough.
CONNECTORS = [
    ("web", "Web & News", "Web & News", ["tavily", "apify"]),
    ("firecrawl", "Firecrawl", "Web & News", ["firecrawl"]),
    ("app_store", "App Store", "App Reviews", []),
    ("google_play", "Google Play", "App Reviews", []),
    ("trustpilot", "Trustpilot", "Review Sites", ["browser"]),
    ("google_maps", "Google Maps", "Review Sites", ["apify"]),
    ("yelp", "Yelp", "Review Sites", ["apify"]),
    ("tripadvisor", "TripAdvisor", "Review Sites", ["apify"]),
    ("reddit", "Reddit", "Social", ["reddit"]),
    ("mastodon", "Mastodon", "Social", []),
    ("hackernews", "Hacker News", "Social", []),
    ("instagram", "Instagram", "Social", ["apify"]),
    ("facebook", "Facebook", "Social", ["apify"]),
]


def connectors(configured: set[str]) -> list[dict]:
    """Which connectors can run with the credentials at hand; those that need none always can."""
    return [{"key": k, "label": label, "category": c, "status": "active" if not needs or configured & {*needs} else "inactive"} for k, label, c, needs in CONNECTORS]


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))


def run_status(failures: int, rows: int) -> str:
    return "error" if failures else "ok" if rows else "empty"


def names_of(brand: str) -> set[str]:
    """The forms in which a question may name a brand: all its words, or the distinctive ones."""
    every = re.findall("[a-z0-9]+", brand.lower())
    distinctive = [w for w in every if w not in GENERIC_BRAND_WORDS and w[1:]]
    return {" ".join(every), " ".join(distinctive)} - {""}


def resolve_targets(question: str, brand: str | None = None, brands: list[str] | None = None) -> list[str]:
    """What a question is about, the driver's form of `functions.text.mentions`: the brands that it names, or else the one
    that is selected, or else every brand on offer."""
    choices = dict.fromkeys(filter(None, brands or [brand]))
    asked = " ".join(["", *re.findall("[a-z0-9]+", (question or "").lower()), ""])
    named = [b for b in choices if any(n in asked for n in names_of(b))]
    if named or not brand:
        return named or list(choices)
    return [brand]
