"""Lists, thresholds and bucket bounds the results depend on."""

from __future__ import annotations

# Accounts whose feeds are read in full.
RELIABLE_ACCOUNTS = [
    "reuters.com",
    "apnews.com",
    "afp.com",
    "bbc.com",
    "theguardian.com",
    "lemonde.fr",
    "nytimes.com",
    "npr.org",
    "bloomberg.com",
    "politico.com",
]

# Domains whose handles and sub-handles count as reliable.
RELIABLE_DOMAINS = [
    "reuters.com",
    "apnews.com",
    "afp.com",
    "nytimes.com",
    "washingtonpost.com",
    "wsj.com",
    "usatoday.com",
    "npr.org",
    "pbs.org",
    "cbsnews.com",
    "nbcnews.com",
    "abcnews.com",
    "cnn.com",
    "politico.com",
    "thehill.com",
    "theatlantic.com",
    "newyorker.com",
    "foreignpolicy.com",
    "bloomberg.com",
    "bbc.co.uk",
    "bbc.com",
    "theguardian.com",
    "independent.co.uk",
    "ft.com",
    "economist.com",
    "sky.com",
    "lemonde.fr",
    "lefigaro.fr",
    "liberation.fr",
    "spiegel.de",
    "faz.net",
    "zeit.de",
    "who.int",
    "un.org",
    "ec.europa.eu",
    "snopes.com",
    "factcheck.org",
    "politifact.com",
    "fullfact.org",
]

# Search themes and their keywords, in search order.
THEMES = {
    "Discover": ["news", "world news", "science", "technology", "research"],
    "Trending": ["breaking news", "urgent", "live updates", "alert"],
    "Hot Topics": ["politics", "election", "climate", "crisis", "economy", "AI"],
    "Misinformation": ["fact check", "debunked", "misinformation", "conspiracy", "hoax"],
}

# Words that are never reported as keywords.
KEYWORD_BLACKLIST = [
    "be", "have", "do", "not", "say", "get", "make", "go", "know", "see", "use",
    "would", "could", "should", "the", "a", "an", "is", "it", "in", "of", "to",
    "and", "or", "for", "on", "at", "by", "with", "this",
    "de", "la", "le", "et", "les", "des", "un", "une", "pour", "dans", "que",
    "qui", "sur", "pas", "plus", "ne", "au", "aux",
]

# Shortest keyword.
MIN_KEYWORD_LENGTH = 3

# Report order of the categories.
CATEGORY_PRIORITY = ["Reliable", "Misinformation", "Hot Topics", "Discover", "Trending"]

# Emotion labels.
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]

# Probability thresholds.
LIKELY = 0.60
PROBABLE = 0.40
POSSIBLE = 0.20

# Feature sizes and model settings.
STYLE_SIZE = 5
EMBEDDING_SIZE = 384
CLUSTERS = 2
SEED = 42
EPSILON = 1e-8
MARGIN_GAIN = 20.0

# Histogram bucket bounds (seconds, seconds, characters).
HTTP_LATENCY_BUCKETS = [0.1, 0.5, 1.0]
ANSWER_LATENCY_BUCKETS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0]
CONTEXT_CHARS_BUCKETS = [0.0, 100.0, 300.0, 500.0, 1000.0, 2000.0, 5000.0]
CONTEXT_CHARS_TARGET = 300.0

# Fixed values: (warning, critical) bounds; for the hit rate low is bad.
BANDS = {
    "error_rate": (1.0, 5.0),
    "hit_rate": (40.0, 70.0),
    "context_chars": (200.0, 300.0),
    "cpu": (70.0, 90.0),
    "ram": (75.0, 90.0),
    "disk": (75.0, 90.0),
}
