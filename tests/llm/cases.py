"""Documents that the text operators must take without harm, and plain versions of the operators."""

from collections import Counter

PARTS = ("th", "er", "on", "an"), ("ing", "at", "o", "en"), ("", "s", "ly", "ed")
WORDS = [f"{a}{b}{c}" for a in PARTS[0] for b in PARTS[1] for c in PARTS[2]]


def prose(seed: int, n: int) -> str:
    """``n`` words, different for every seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 13))
    return " ".join(out)


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, label int, "
    "rep long, n int, signature string, component string, text_hash long, minimizer string"
)


def docs(spark, texts, langs=None):
    """A table from ``(doc_id, text)`` pairs, with columns named like those the operators use."""
    rows = [
        (doc_id, text, (langs or {}).get(doc_id, "en"), "s", len(text or ""), 1.0, 3, 5, 7, "x", "y", 9, "z")
        for doc_id, text in texts
    ]
    return spark.createDataFrame(rows, SCHEMA)


LONG = prose(99, 30_000)
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "word"),
    (5, "one two three"),
    (6, prose(1, 120)),
    (6, prose(1, 120)),
    (None, prose(2, 80)),
    (None, None),
    (7, "be " * 400),
    (8, LONG),
    (9, "ünï çødé \U0001f600 中文字 <|endoftext|> a\x1cb \x00"),
    (-5, prose(3, 60)),
    (1 << 60, prose(4, 60)),
]


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[i:] for i in range(size))))


def reach(nodes, links):
    """Smallest node reachable of each node."""
    label = {node: node for node in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def kept_words(texts, window=35):
    """Per text its words, those that no repeated window covers, and how many go."""
    words = [(text or "").encode().split() for text in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, [x for x, g in zip(w, gone) if not g], sum(gone)))
    return out
