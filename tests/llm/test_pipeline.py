"""The pipeline's stages against brute force on a small corpus, and the registered queries."""

import hashlib
import itertools

import public_tokenizers
import pytest
from cases import docs, kept_words, prose, reach, shingles
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from duskline.llm import decontaminate
from duskline.llm.queries import ORACLE, QUERIES
from duskline.llm.tokens import load


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, copies, a shared passage, a leak, and texts without a letter."""
    folder = tmp_path_factory.mktemp("corpus")
    passage, item = prose(1, 60), prose(2, 45)
    texts = [(i, prose(100 + i, 150)) for i in range(20)]
    texts += [(30 + i, prose(100 + i, 150)) for i in range(4)]
    texts += [(40, prose(101, 150) + " end"), (41, f"{prose(50, 60)} {passage}"), (42, f"{prose(51, 60)} {passage}")]
    texts += [(43, f"{prose(52, 80)} {item} {prose(53, 80)}"), (44, "123 456 !!"), (45, None), (46, "")]
    table = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, item


def brute_force(texts, item):
    kept = [(d, t) for d, t in texts if t and any(c.isalpha() for c in t)]
    sets = {d: shingles(t) for d, t in kept}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    label = reach(sets, links)
    kept = [(d, t) for d, t in kept if label[d] == d]
    cut = kept_words([t for _, t in kept])
    kept = [
        (d, b" ".join(left).decode() if gone else t) for (d, t), (_, left, gone) in zip(kept, cut)
    ]
    wanted = decontaminate._shingles(decontaminate.words_of(item))
    return {
        d: t
        for d, t in kept
        if len(wanted & decontaminate._shingles(decontaminate.words_of(t))) < 0.75 * len(wanted)
    }


def test_the_pipeline_equals_brute_force(spark, corpus):
    folder, texts, item = corpus
    library = load(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    expected = brute_force(texts, item)
    assert 43 not in expected and 30 not in expected and 40 not in expected
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(found) == set(expected)
    for doc_id, text in expected.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[doc_id]["ids"] == ids and found[doc_id]["n_tokens"] == len(ids)
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_stages_keep_the_columns_and_every_clean_document(spark, corpus):
    folder, _, _ = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet")
    clean = table.where("doc_id < 20")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clean, folder)
        assert found.columns == table.columns, name
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, clean.collect())), name


def test_stages_take_an_empty_table(spark, corpus):
    folder, _, _ = corpus
    empty = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_every_operator_is_registered_once():
    names = [name for name in entry.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 11))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(ORACLE) <= set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5
