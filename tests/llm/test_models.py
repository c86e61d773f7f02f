"""Language, toxicity and quality: held-out accuracy and odd rows."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from cases import ODD, docs
from pyspark.sql import functions as F

from duskline.llm import language, quality, toxicity
from duskline.llm.common import held_out

SYLLABLES = {
    "en": "the and ing tion er on with that".split(),
    "de": "sch ung ein der zw ö pf ich".split(),
    "el": "καλ ημέ ρα ος την και εί ου".split(),
}
BAD = ["blorptic", "vexnard", "grumzelt"]


def text_of(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def languages(spark):
    names = list(SYLLABLES)
    texts = [(i, text_of(names[i % 3], i)) for i in range(240)]
    return docs(spark, texts, {i: names[i % 3] for i in range(240)})


def test_languages_of_held_out_texts_are_found(languages):
    found = language.identified(languages).join(languages.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["held_out"] for r in found) > 30
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in found)


def test_odd_texts_have_a_defined_language(spark, languages):
    table = languages.union(docs(spark, [(d if d is None else d + 10**6, t) for d, t in ODD]))
    rows = language.identified(table).where("doc_id is null or doc_id > 900000").collect()
    assert len(rows) == len(ODD)
    for row in rows:
        if row["doc_id"] in (10**6 + 1, 10**6 + 2, 10**6 + 3):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_nothing_to_learn_from_is_undetermined(spark):
    table = docs(spark, [(1, "some words"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identified(table).collect()} == {"und"}
    assert language.identified(table.where("false")).count() == 0


def test_a_text_is_the_sum_of_bound_letters():
    profiles = language.Profiles(64, 1)
    codes, counts = profiles.triples("!Aa")
    assert counts.tolist() == [1, 1, 1] and len(codes) == 3
    a, s = profiles._letter(ord("a")), profiles._letter(32)
    triples = [(s, s, a), (s, a, a), (a, a, s)]
    expected = sum(np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in triples)
    assert profiles.vector(codes, counts).tolist() == expected.tolist()


def test_a_small_memory_gives_the_same_vectors():
    wide, narrow = language.Profiles(64, 1), language.Profiles(64, 1, remembered=5)
    for seed in range(5):
        found = [p.vector(*p.triples(text_of("de", seed))) for p in (wide, narrow)]
        assert found[0].tolist() == found[1].tolist()


@pytest.fixture(scope="module")
def toxic(spark):
    texts, labels = [], []
    for i in range(600):
        words = text_of("en", i, 80).split()
        if i % 4 == 0:
            rng = random.Random(i)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_held_out_texts_are_found(toxic):
    found = toxicity.scored_documents(*toxic).join(toxic[1].select("doc_id", "toxic"), "doc_id")
    rows = found.where("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert len(rows) > 80 and np.mean(right) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_odd_texts_have_a_toxicity(spark, toxic):
    odd = docs(spark, ODD)
    rows = toxicity.scored_documents(odd, toxic[1].where("false")).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.0}
    model = toxicity.learn_toxicity(*toxic)
    scores = [r["score"] for r in toxicity.score_toxicity(odd, model, F.col("doc_id")).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score_toxicity(odd.where("false"), model, F.col("doc_id")).count() == 0


def test_a_score_does_not_depend_on_how_the_sample_is_cut(spark):
    texts, labels = [], []
    for i in range(2400):
        rng = random.Random(i)
        words = text_of("en", i, 30).split()
        toxic = int(i % 10 == 0)
        if rng.random() < (0.9 if toxic else 0.04):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append((i, " ".join(words)))
        labels.append((i, toxic))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    fixed = docs(spark, [(1, f"{text_of('en', 9999, 30)} {BAD[0]}"), (2, text_of("en", 9998, 30))])

    def scores(size):
        model = toxicity.learn_toxicity(docs(spark, texts), labels, size)
        assert model.dictionaries is not None
        rows = toxicity.score_toxicity(fixed, model, F.col("doc_id")).orderBy("doc_id").collect()
        return np.array([r["score"] for r in rows])

    whole, cut = scores({1: 3000, 0: 8000}), scores({1: 200, 0: 400})
    assert 0.5 < whole[0] < 0.85 and np.abs(whole - cut).max() < 0.12
    weighed = toxicity.sample_weights(labels, "toxic", {1: 200, 0: 400})
    assert weighed == {1: 1.2, 0: 5.4}


def test_a_share_without_a_model_is_that_of_all_labels(spark):
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(20)], "doc_id long, toxic int")
    texts = docs(spark, [(i, f"text {i}") for i in range(20)])
    model = toxicity.learn_toxicity(texts, labels, {1: 1, 0: 1})
    assert model.dictionaries is None and model.weights.tolist() == [0.1]


def test_conflicting_and_empty_labels_are_not_learned_from(spark):
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (2, 1), (2, 1), (3, None), (None, 1), (4, 0), (5, 7)], "doc_id long, toxic int"
    )
    found = toxicity.labelled_sample(labels, "toxic", {1: 10, 0: 10}).collect()
    assert sorted(map(tuple, found)) == [(2, 1), (4, 0)]


def test_gains_do_not_depend_on_the_memory():
    common = {w for i in range(40) for w in text_of("en", i).lower().rstrip(".").split()}
    words = [(w, 30, 0) for w in BAD] + [(w, 40, 90) for w in sorted(common)]
    dictionaries = toxicity.build_dictionaries(words, 100, 100)
    assert all(word.encode() in dictionaries.toxic for word in BAD)
    wide, narrow = toxicity.Gains(dictionaries), toxicity.Gains(dictionaries, remembered=1)
    text = f"the {BAD[0]}, and! {BAD[1].upper()} with that"
    assert wide.features(text).tolist() == narrow.features(text).tolist()
    assert wide._gain(BAD[0]) > wide._gain("that")


@pytest.fixture(scope="module")
def graded(spark):
    texts, labels = [], []
    for i in range(500):
        words = text_of("en", i, 80).split()
        kind = i % 5
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [words[0]] * 40 + [words[1]] * 40
        texts.append((i, " ".join(words)))
        labels.append((i, int(kind > 1), 0))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_of_held_out_texts_is_found(graded):
    found = quality.scored_documents(*graded).join(graded[1].select("doc_id", "quality"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 60 and all(r["predicted"] == r["quality"] for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_rules_are_columns_of_the_engine(spark, graded):
    model = quality.learn_quality(*graded)
    assert 0 < len(model.rules) < 200 and all(weight for _, weight in model.rules)
    scored = quality.score_quality(docs(spark, ODD), model, F.col("doc_id"))
    text = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
    assert len(scored.collect()) == len(ODD)
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert quality.score_quality(docs(spark, []).where("false"), model, F.col("doc_id")).count() == 0


def test_quality_without_both_labels_is_a_share(spark, graded):
    for kept, score in (("quality = 1", 1.0), ("quality = 0", 0.0), ("false", 0.0)):
        found = quality.scored_documents(graded[0], graded[1].where(kept)).select("score").distinct()
        assert [r["score"] for r in found.collect()] == [score]


def test_tree_paths_become_rules():
    printed = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 0 <= 1.5)
      Predict: 0.0
     Else (feature 0 > 1.5)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 7.0E-4)
     Predict: 0.0
    Else (feature 1 > 7.0E-4)
     Predict: 1.0"""
    rules = {rule.parts for rule in quality.tree_rules(printed, ["a", "b"])}
    assert rules == {
        (("a", False, 2.5),),
        (("a", False, 1.5),),
        (("a", False, 2.5), ("a", True, 1.5)),
        (("a", True, 2.5),),
        (("b", False, 7e-4),),
        (("b", True, 7e-4),),
    }


def test_held_out_rows_follow_the_checksum(spark):
    import zlib

    rows = spark.range(-20, 60).select("id", held_out(F.col("id"), 5, 0).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def plain_vector(text, seed=language.SEED, size=language.DIMENSIONS):
    """A text's vector, triple by triple."""
    letters = [c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()]
    # A run of other characters is one space; the text stands between two more.
    inner = re.sub(" +", " ", "".join(letters))
    line = f" {inner} " if inner.strip() else ""
    total = np.zeros(size)
    for a, b, c in zip(line, line[1:], line[2:]):
        x, y, z = (
            np.random.default_rng([seed, ord(one)]).integers(0, 2, size).astype(float) * 2 - 1 for one in (a, b, c)
        )
        total += np.roll(x, 2) * np.roll(y, 1) * z
    return total


def test_languages_equal_a_plain_version(spark):
    names = list(SYLLABLES)
    texts = [(i, text_of(names[i % 3], i, 12) + " 1, 2 -- É!") for i in range(60)] + [(60, ""), (61, None), (62, "12 ?")]
    lang = {i: names[i % 3] for i in range(63)}
    vectors = {i: plain_vector(text or "") for i, text in texts}
    out = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    sums = {name: sum(vectors[i] for i in vectors if i not in out and lang[i] == name) for name in sorted(names)}
    table = {name: v / np.linalg.norm(v) for name, v in sums.items()}
    found = {r["doc_id"]: r for r in language.identified(docs(spark, texts, lang)).collect()}
    assert {i for i, r in found.items() if r["held_out"]} == out and len(out) > 5
    for i, v in vectors.items():
        if not v.any():
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        likeness = {name: float(t @ v / np.linalg.norm(v)) for name, t in table.items()}
        assert found[i]["lang_pred"] == max(likeness, key=likeness.get)
        assert found[i]["score"] == pytest.approx(max(0.0, *likeness.values()), abs=1e-6)


def test_a_kept_text_comes_back_as_it_was(spark):
    texts = [(i, text_of("en", i, 9)) for i in range(8)] + [(8, None), (9, "")]
    table = docs(spark, texts)
    named = language.predict_language(table, language.learn_prototypes(table), *[F.col(c) for c in table.columns])
    assert named.columns == [*table.columns, "lang_pred", "score"]
    assert sorted((r["doc_id"], r["text"]) for r in named.collect()) == sorted(texts)
