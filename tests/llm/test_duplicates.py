import hashlib
import itertools
import tracemalloc

import numpy as np
import pytest
from cases import LONG, ODD, docs, kept_words, prose, reach, shingles

from duskline.llm import embeddings, near_duplicates, repeats
from duskline.llm.components import components
from duskline.llm.shingles import shingle_set, word_hashes


def edited(text, every, word="CHANGED"):
    words = text.split()
    for i in range(every // 2, len(words), every):
        words[i] = f"{word}{i}"
    return " ".join(words)


def near_cases():
    base, other = prose(11, 300), prose(12, 200)
    texts = [(i, edited(base, 20 + 7 * i, f"w{i}x")) for i in range(10, 40)]
    texts += [(100 + i, edited(other, 60 + i)) for i in range(6)] + [(200, base), (201, base.upper())]
    # A passage that many otherwise different documents share.
    passage = prose(13, 60)
    texts += [(300 + i, f"{prose(400 + i, 90)} {passage}") for i in range(40)]
    # A chain: each is near the next only.
    words = prose(14, 400).split()
    texts += [(500 + i, " ".join(words[25 * i : 25 * i + 240])) for i in range(6)]
    return texts + [(d, t) for d, t in ODD if d is not None]


def expected_components(texts):
    sets = {d: shingles(t) for d, t in texts}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, reach(sets, links)


@pytest.mark.parametrize("chunk", [near_duplicates.CHUNK, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_duplicates, "CHUNK", chunk)
    texts = near_cases()
    sets, label = expected_components(texts)
    found = near_duplicates.near_duplicates(docs(spark, texts)).collect()
    assert len(found) == len(texts)
    for row in found:
        assert row["n_shingles"] == len(sets[row["doc_id"]])
        assert row["component_id"] == label[row["doc_id"]]
        assert row["kept"] == (row["doc_id"] == row["component_id"])


def test_a_worker_keeps_no_list_of_words():
    shingle_set("so that all is loaded", 5)
    tracemalloc.start()
    for i in range(20):
        assert len(shingle_set(" ".join(f"w{j}" for j in range(5000 * i, 5000 * i + 5000)), 5)) == 4996
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 1_000_000


def test_words_have_hashes_of_their_own():
    words = ["a", "b", "ab", "ba", "aa", "a\0", "\0a", "x" * 64, "x" * 65, "x" * 66, "\xe9", "A\x0e", "\x1c"]
    hashes = word_hashes("\t" + " ".join(words) + "\x0b\n" + "\r".join(words))
    assert hashes[: len(words)].tolist() == hashes[len(words) :].tolist()
    assert len(set(hashes.tolist())) == len(words)
    assert word_hashes("Ab \xc9", lower=True).tolist() == word_hashes("ab \xc9").tolist()
    assert len(word_hashes(" \t")) == len(word_hashes(None)) == 0


def test_rows_without_id_are_kept(spark):
    rows = near_duplicates.near_duplicates(docs(spark, ODD)).where("doc_id is null").collect()
    assert [(r["component_id"], r["kept"]) for r in rows] == [(None, True)] * 2


def test_the_estimate_is_exact_for_small_sets():
    sets = [np.sort(np.array(x, np.uint64)) for x in ([1, 2, 3, 4], [2, 3, 4, 5], [9])]
    assert near_duplicates._estimated(sets, sets).round(3).tolist() == [[1, 0.6, 0], [0.6, 1, 0], [0, 0, 1]]


def test_no_documents(spark):
    empty = docs(spark, []).where("false")
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert repeats.deduplicated(empty).count() == 0


def repeat_cases():
    passage = prose(21, 70)
    texts = [(i, f"{prose(30 + i, 50)} {passage} {prose(60 + i, 50)}") for i in range(5)]
    texts += [(20, f"{passage} {prose(90, 20)} {passage}")]  # twice in one document
    texts += [(21, " ".join(passage.split()[:34]))]  # a word too short
    texts += [(22, " ".join(passage.split()[3:38]) + " end")]  # one window
    texts += [(23, edited(passage, 36)), (24, prose(91, 500)), (25, prose(91, 500).replace("s", "z", 3))]
    return texts + ODD


def test_repeats_equal_brute_force(spark):
    texts = repeat_cases()
    expected = sorted(
        (str(d), len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest())
        for (d, _), (words, kept, gone) in zip(texts, kept_words([t for _, t in texts]))
    )
    found = repeats.deduplicated(docs(spark, texts)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == expected


def test_one_id_with_two_texts_stays_two_documents(spark):
    passage = prose(5, 50)
    found = repeats.deduplicated(docs(spark, [(1, passage), (1, prose(6, 60)), (2, f"a {passage}")]))
    assert sorted((r[0], r[1], r[2]) for r in found.collect()) == [(1, 50, 50), (1, 60, 0), (2, 51, 50)]


def test_paths_do_not_depend_on_what_is_around():
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 500).astype(np.uint64)
    whole, part = repeats.paths_of(hashes), repeats.paths_of(hashes[100:300])
    inside = set(zip(whole[0].tolist(), whole[1].tolist()))
    # All but the paths at both cut ends.
    assert sum((m, w) in inside for m, w in zip(part[0].tolist(), part[1].tolist())) >= len(part[0]) - 2


def test_long_texts_have_all_windows():
    hashes = repeats.WORDS.hashed(LONG.encode().split())
    assert repeats.paths_of(hashes)[3].sum() == len(hashes) - 34


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {i: 0 for i in range(51)} | {
        i: 100 for i in range(100, 140)
    }


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_cases():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    near = (centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * 0.22).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(near)]
    rows += [(1000 + i, near[0].tolist()) for i in range(40)]
    rows += [(2000, (near[1] * 7).tolist()), (2001, None), (2002, [0.0] * 16), (2003, [float("nan")] * 16)]
    rows += [(2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [])]
    return rows + [(None, near[0].tolist())]


@pytest.mark.parametrize("interval,leaf", [(embeddings.INTERVAL, embeddings.LEAF), (16, 4)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_equal_brute_force(spark, monkeypatch, interval, leaf, kind):
    monkeypatch.setattr(embeddings, "INTERVAL", interval)
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    rows = vector_cases()
    good = {i: np.array(x) for i, x in rows if i is not None and i <= 2000}
    links = [
        (a, b)
        for a, b in itertools.combinations(good, 2)
        if good[a] @ good[b] >= 0.9 * np.linalg.norm(good[a]) * np.linalg.norm(good[b])
    ]
    label = reach(good, links)
    n = {i: sum(i in pair for pair in links) for i in good}
    table = spark.createDataFrame(
        [(i, x, 1, 2, 3) for i, x in rows], f"vec_id long, embedding array<{kind}>, label int, rep int, size int"
    )
    found = embeddings.linked_vectors(table).collect()
    assert len(found) == len(rows)
    for row in found:
        i = row["vec_id"]
        assert row["n_links"] == n.get(i, 0)
        assert row["component_id"] == label.get(i, i)
        assert row["kept"] == (i is None or label.get(i, i) == i)


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.linked_vectors(table).count() == 0
    table = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.linked_vectors(table).collect()] == [(1, 0, 1, True)]
