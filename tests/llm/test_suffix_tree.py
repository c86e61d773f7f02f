"""Suffix tree scores against a plain version that keeps whole contexts in dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, docs, prose

from duskline.llm import suffix_tree


class PlainTree:
    def __init__(self, texts, depth=2, least=2, gain=3.0):
        self.depth = depth
        train = [self.words(text) for doc_id, text in texts if not self.held(doc_id)]
        self.counts = Counter(w for words in train for w in words)
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        after = defaultdict(Counter)
        for words in train:
            line = [None, *words]
            for i in range(1, len(line)):
                for d in range(1, min(i, depth) + 1):
                    after[tuple(line[i - d : i])][line[i]] += 1
        self.states = {}
        for context in sorted(after, key=len):
            n = sum(after[context].values())
            expected = {w: self.next(context[1:], w) for w in after[context]}
            parts = [c * math.log(c / n / expected[w]) for w, c in after[context].items()]
            if n >= least and sum(parts) >= gain:
                self.states[context] = after[context]

    @staticmethod
    def held(doc_id):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0

    @staticmethod
    def words(text):
        return [*(text or "").encode().lower().split(), "end"]

    def base(self, word):
        return (self.counts[word] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def next(self, context, word):
        p = self.base(word)
        for d in range(1, len(context) + 1):
            seen = self.states.get(tuple(context[-d:]))
            if seen:
                p = (seen[word] + len(seen) * p) / (seen.total() + len(seen))
        return p

    def row(self, doc_id, text):
        words = self.words(text)
        line = [None, *words]
        known = sum(w in self.counts for w in words)
        base = sum(math.log10(self.base(w)) for w in words)
        contexts = [line[max(0, i - self.depth) : i] for i in range(1, len(line))]
        score = sum(math.log10(self.next(c, w)) for c, w in zip(contexts, words))
        return self.held(doc_id), len(words), known, self.n, pytest.approx(base), pytest.approx(score)


def scored(df, **options):
    rows = suffix_tree.score_texts(df, **options).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


def expected(texts, **options):
    tree = PlainTree(texts, **options)
    rows = [(doc_id, *tree.row(doc_id, text)) for doc_id, text in texts]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


def sentences(n):
    rng = random.Random(4)
    parts = [prose(i, 12) for i in range(8)]
    return [(i, " ".join(rng.choice(parts) if rng.random() < 0.7 else prose(100 + i, 9) for _ in range(6))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 900, "bucket_keys": 300}])
def test_scores_equal_the_plain_tree(spark, sizes):
    texts = sentences(80)
    found = scored(docs(spark, texts), **sizes)
    assert found == expected(texts)
    gained = [score - base for _, held, *_, base, score in found if held]
    assert len(gained) >= 5 and min(gained) > 0


@pytest.mark.parametrize("depth", [1, 4])
def test_other_depths_and_thresholds(spark, depth):
    texts = sentences(30)
    found = scored(docs(spark, texts), depth=depth, least_count=3, gain=8.0, block_bytes=2000)
    assert found == expected(texts, depth=depth, least=3, gain=8.0)


def test_states_sum_to_one():
    texts = sentences(40)
    tree = PlainTree(texts)
    assert max(len(context) for context in tree.states) == 2
    for context in random.Random(1).sample(sorted(tree.states, key=str), 30):
        total = sum(tree.next(context, word) for word in [*tree.counts, "an unknown word"])
        assert total == pytest.approx(1)


def test_odd_texts_and_empty_tables(spark):
    texts = ODD + [(30, "A a b É é \x1f x"), (31, "a A")] + [(40 + i, "same same same") for i in range(30)]
    assert scored(docs(spark, texts)) == expected(texts)
    assert scored(docs(spark, [])) == []


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if PlainTree.held(i))
    assert scored(docs(spark, [(held, "one two")])) == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_words_of_many_texts_are_parted_at_once():
    """As bytes.lower and bytes.split, whatever the bytes; a word is not looked at by Python one by one."""
    raw = [None, b"", b" ", b" a A\t\x0bb ", "\xc9 \xe9\x1fX \u2028y\x85 \u0130".encode(), b"\xff\xfeQ q", bytes(range(256))]
    for texts in (pa.array(raw, pa.binary()), pa.array([b"x y", *raw, b"z"], pa.binary())[1:-1], pa.array([], pa.binary())):
        words, places, lengths = suffix_tree._words(texts)
        wanted = [(text or b"").lower().split() for text in texts.to_pylist()]
        assert lengths.tolist() == [len(own) for own in wanted]
        assert words.tolist() == list(dict.fromkeys(word for own in wanted for word in own))
        assert [None if n == 0 else words[n - 1] for n in places] == [w for own in wanted for w in (*own, None)]


def test_numbers_take_the_bytes_they_need():
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 200, 5000), rng.integers(-(1 << 62), 1 << 62, 9), np.zeros(0, np.int64), np.array([-1, 0])):
        assert suffix_tree._values(suffix_tree._planes(values), "<i8").tolist() == values.tolist()
    keys = np.sort(rng.integers(0, 1 << 64, 20_000, np.uint64))
    ask = 0, keys, rng.integers(0, 60, len(keys)), np.zeros(0, np.int64)
    row = suffix_tree._dealt(7, iter([ask]), 1).iloc[0]
    assert suffix_tree._stepped(row["keys"]).tolist() == keys.tolist()
    assert len(row["keys"]) + len(row["counts"]) + len(row["gains"]) < 9 * len(keys)
