"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from duskline.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, part int, n string, v int"


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, "y", 2) for row in rows], SCHEMA)


def brute_force(rows):
    known = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        row = label, [math.floor(256 * float(np.float32(x))) for x in vector]
        known[vec_id] = min(known.get(vec_id, row), row)
    out = set()
    for a, (label, v) in known.items():
        if a % 100:
            continue
        scores = [
            (-sum(x * y for x, y in zip(v, w)), i, other == label)
            for i, (other, w) in known.items()
            if i != a and len(w) == len(v)
        ]
        scores.sort()
        for minus, positive, _ in [s for s in scores if s[2]][:5]:
            held = [s for s in scores if not s[2] and 80 * minus >= 100 * s[0] >= 100 * minus]
            out |= {(a, positive, r, i, -minus, -s) for r, (s, i, _) in enumerate(held[:5], start=1)}
    return out


def found(df, **options):
    rows = [tuple(r) for r in negatives.hard_negatives(df, **options).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def clustered(seed, n=900, d=16, groups=6, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    # A group holds a third of all rows, and rows are repeated among themselves.
    group = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    vectors = centres[group] + noise * rng.normal(size=(n, d))
    vectors[rng.random(n) < 0.2] = vectors[0]
    labels = rng.integers(0, 3, n)
    return [(i * 5, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(vectors, labels))]


@pytest.mark.parametrize("sizes", [{}, {"n_rows": 100, "n_anchors": 7}])
def test_negatives_equal_brute_force(spark, sizes):
    rows = clustered(1)
    expected = brute_force(rows)
    assert len(expected) > 500
    assert found(table(spark, rows), **sizes) == expected


def test_odd_rows(spark):
    rows = [(i, [0.5, float(i % 7), -1.0], i % 3) for i in range(-200, 400, 4)]
    rows += [(i, [1.0, float(i % 5)], i % 2) for i in range(500, 700, 10)]
    rows += [
        (1001, None, 1),
        (1002, [1.0, None, 2.0], 1),
        (1003, [1.0, float("nan"), 2.0], 1),
        (1004, [float("inf"), 0.0, 1.0], 1),
        (None, [1.0, 2.0, 3.0], 1),
        (1100, [1.0, 2.0, 3.0], None),
        (1200, [0.0, 0.0, 0.0], 1),
        (1201, [0.0, 0.0, 0.0], 2),
        (1202, [0.0, 0.0, 0.0], 1),
        (1300, [], 1),
        (1301, [], 1),
        (1302, [], 3),
        (100, [9.0, 9.0, 9.0], 9),
        (0, [0.5, 0.0, -1.0], 1),
        (1400, [-1.0, -1.0, -1.0], 1),
        (1500, [1e5, 3e5, -2e5], 1),
        (1501, [1e5, 3e5, -2e5], 1),
        (1502, [1e5, 2.9e5, -2e5], 2),
    ]
    expected = brute_force(rows)
    assert {a for a, *_ in expected} >= {1200, 1300, 1500}
    assert found(table(spark, rows)) == expected
    assert found(table(spark, [])) == set()
    assert found(table(spark, [(1, [1.0], 1), (100, [1.0], 2)])) == set()


def test_scores_beyond_doubles_are_exact():
    """Whole numbers of Python take over where a score is not exact in doubles."""
    large = [[2**30 + 1, 3], [2**30, 5], [2**30 + 2, -4]]
    a, b = negatives._matrices(large, large)
    assert a.dtype == object
    n = len(large)
    slots = np.arange(n), np.zeros(n, int), True, np.full(n, -np.inf), np.full(n, np.inf)
    slot, score, ids = negatives.walk((a, np.arange(n)), slots, (b, np.zeros(n, int), np.arange(n)), 1)
    assert list(zip(slot, score, ids)) == [
        (i, *max(((sum(x * y for x, y in zip(v, w)), j) for j, w in enumerate(large) if i != j), key=lambda p: (p[0], -p[1])))
        for i, v in enumerate(large)
    ]


def test_a_narrow_cluster_walks_only_the_head_of_its_list(monkeypatch):
    rng = np.random.default_rng(3)
    centres = np.eye(40, 64) * 300
    rows = np.floor(np.repeat(centres, 500, axis=0) + rng.normal(size=(20_000, 64)))
    anchors = rows[:8]
    looked = []
    first = negatives._first
    monkeypatch.setattr(negatives, "_first", lambda *a: looked.append(1) or first(*a))
    slots = np.arange(8), np.zeros(8, int), True, np.full(8, -np.inf), np.full(8, np.inf)
    block = rows, np.zeros(20_000, int), np.arange(20_000)
    slot, score, ids = negatives.walk((anchors, np.arange(8)), slots, block, 5)
    assert len(looked) <= 2
    exact = anchors @ rows.T
    exact[np.arange(8), np.arange(8)] = -np.inf
    for i in range(8):
        assert sorted(score[slot == i])[::-1] == sorted(exact[i])[::-1][:5]
