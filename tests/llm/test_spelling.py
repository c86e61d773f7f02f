"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from cases import ODD, docs

from duskline.llm import spelling


def plain_words(texts):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(texts):
    words = plain_words(texts)
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    best = {a: min(bs, key=lambda b: (-words[b], b)) for a, bs in near.items() if bs}
    form = {a: b for a, b in best.items() if words[b] >= 10 * words[a]}

    def root(a):
        while a in form:
            a = form[a]
        return a

    return {a: (form.get(a), root(a), words[a], len(near[a]), words.get(form.get(a))) for a in words}


def variants(df, **options):
    found = spelling.spelling_variants(df, **options).collect()
    assert len({r["word"] for r in found}) == len(found)
    return {r["word"]: tuple(r)[1:] for r in found}


def misspelt(seed, stems, n):
    """Texts of some words with edits, of which those without one are far more frequent."""
    rng = random.Random(seed)
    letters = "abcdeé÷Ä"
    out = []
    for i in range(n):
        words = []
        for _ in range(60):
            word = rng.choice(stems)
            if rng.random() < 0.15:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", rng.choice(letters), rng.choice(letters) + word[at]]) + word[at + 1 :]
            words.append(rng.choice([word, word.upper() if word.isascii() else word]))
        out.append((i, " ".join(words) + "; Übergrößen, straße-über"))
    return out


@pytest.mark.parametrize("group_pairs", [1, spelling.GROUP_PAIRS])
def test_variants_equal_brute_force(spark, group_pairs, monkeypatch):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (group_pairs,))
    texts = misspelt(1, ["aabbaabb", "abababab", "calendar", "calender", "aaaaaaa", "separate", "straßen"], 60)
    expected = plain_variants(texts)
    assert sum(v[0] is not None for v in expected.values()) > 20
    assert variants(docs(spark, texts)) == expected


def test_words_that_share_a_half_are_cut_further(spark):
    """A third of all words begin alike; no group gives all its pairs."""
    rng = random.Random(5)
    tails = {"".join(rng.choices("abcdef", k=8)) for _ in range(700)}
    words = ["internationalisation" + tail for tail in tails] + ["x" + t for t in tails] + [t + "yz" for t in tails]
    texts = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:50] * 30))]
    assert variants(docs(spark, texts)) == plain_variants(texts)


def test_chains_of_forms_lead_to_their_last(spark):
    texts = [(i, "overlook " * 100 if i else "overlooks " * 1000) for i in range(3)]
    texts += [(9, "overlool overlool overlool " * 2)]
    found = variants(docs(spark, texts))
    assert found == plain_variants(texts)
    assert found["overlool"][:2] == ("overlook", "overlook")


def test_odd_and_empty_tables(spark):
    giant = [(20, "ab" * 60_000), (21, "ab" * 60_000), (22, "ab" * 60_000)]
    plain = [(d, None if t is None else t) for d, t in ODD * 2 + giant]
    expected = plain_variants([row for row in plain if row not in giant])
    expected |= {w: (None, w, n, 0, None) for w, n in plain_words(giant).items()}
    assert variants(docs(spark, plain)) == expected
    assert variants(docs(spark, [])) == {}
    assert variants(docs(spark, [(1, None), (None, "")])) == {}
