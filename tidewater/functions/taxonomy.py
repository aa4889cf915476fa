"""Sources, their categories, labels and hosts, and which need no relevance check."""

# Category and label of each source, in display order.
SOURCES = [
    ("app_store", "App Reviews", "App Store"),
    ("google_play", "App Reviews", "Google Play"),
    ("google_maps", "Review Sites", "Google Maps"),
    ("yelp", "Review Sites", "Yelp"),
    ("tripadvisor", "Review Sites", "TripAdvisor"),
    ("trustpilot", "Review Sites", "Trustpilot"),
    ("reddit", "Social", "Reddit"),
    ("mastodon", "Social", "Mastodon"),
    ("hackernews", "Social", "Hacker News"),
    ("instagram", "Social", "Instagram"),
    ("facebook", "Social", "Facebook"),
    ("youtube", "Social", "YouTube"),
    ("twitter", "Social", "X (Twitter)"),
    ("linkedin", "Social", "LinkedIn"),
    ("tiktok", "Social", "TikTok"),
    ("threads", "Social", "Threads"),
    ("web", "Web & News", "Web & News"),
]
CATEGORIES = ["App Reviews", "Review Sites", "Social", "Web & News"]
OTHER = "Web & News"

# Hosts whose links belong to a source; the first that fits wins.
HOSTS = [
    ("reddit.com", "reddit"),
    ("youtube.com", "youtube"),
    ("youtu.be", "youtube"),
    ("trustpilot.com", "trustpilot"),
    ("news.ycombinator.com", "hackernews"),
    ("x.com", "twitter"),
    ("twitter.com", "twitter"),
    ("linkedin.com", "linkedin"),
    ("instagram.com", "instagram"),
    ("facebook.com", "facebook"),
    ("tiktok.com", "tiktok"),
    ("threads.net", "threads"),
    ("threads.com", "threads"),
]

# Sources that are a brand's own page or app.
TRUSTED = ["app_store", "google_play", "trustpilot", "google_maps", "yelp", "tripadvisor"]

# Words of a brand's name that don't identify it.
GENERIC_BRAND_WORDS = ["coffee", "inc", "co", "company", "ltd", "llc", "corp", "corporation", "group", "the", "brand", "app"]

# Words that make no topic, besides English stop words and the brand's own.
GENERIC_STOP_WORDS = [
    "just", "like", "really", "ve", "don", "didn", "doesn", "got", "get",
    "also", "would", "could", "one", "even", "much", "way", "thing", "im",
    "best", "great", "good", "bad", "worst", "nice", "love", "loved", "amazing",
    "awesome", "terrible", "horrible", "excellent", "review", "reviews",
]

#: English stop words, a list of our own.
STOP_WORDS = """
about above after again against all am an and any are as at be because been before being below between both but by can
cannot did do does doing down during each few for from further had has have having he her here hers him his how if in
into is it its itself me more most my no nor not of off on once only or other our out over own same she should so some
such than that the their them then there these they this those through to too under until up very was we were what when
where which while who whom why will with you your
""".split()
