"""Toxicity of a text by the lengths of its words under two zstandard dictionaries.

Both dictionaries hold frequent words of ordinary text; the toxic one also holds the
character segments that toxic documents have far more often. A window is one word,
put before a carrier that both dictionaries know, so that its length shows even
where it is short. Its gain is what the toxic dictionary saves. The numbers of
windows that reach each gain threshold go through a logistic calibration.

Defined cases: a null text is empty; a text without words scores as no toxic window;
rows with a null id or label, and ids with more than one label, are not learned from;
without rows of both labels the score is the share of label 1, or 0; other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.common import held_out, ready

# At most so many labelled documents of each class are learned from.
SAMPLE = {1: 3000, 0: 8000}
# Words of the sample that reach the driver, the most frequent first.
VOCABULARY = 100_000
GRAM = 5
RATIO = 10.0
LEAST_DOCUMENTS = 10
BASE_WORDS = 300
SEGMENT_BYTES = 4096
THRESHOLDS = (1, 2, 3, 4, 5, 6, 7)


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` of ids with one label, 0 or 1."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where(F.col("label") == F.col("other"))
        .select("doc_id", "label")
    )


def labelled_sample(labels: DataFrame, label: str, size: dict[int, int]) -> DataFrame:
    """``doc_id, label`` of at most ``size`` rows of each class, chosen by a hash of the id."""
    known = learnable(labels, label)
    parts = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for value, rows in size.items()
    ]
    return parts[0].unionByName(parts[1])


def sample_weights(labels: DataFrame, label: str, size: dict[int, int]) -> dict[int, float]:
    """How many labelled rows of a class each of its rows in the sample stands for."""
    counts = learnable(labels, label).groupBy("label").count().collect()
    whole = {row["label"]: row["count"] for row in counts}
    return {y: max(1.0, whole.get(y, 0) / rows) if rows else 1.0 for y, rows in size.items()}


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, size: dict[int, int]) -> DataFrame:
    """Distinct texts of the sample with ``label`` and ``calibrates``, every other text by hash.

    The sample is at most ``size`` rows of two numbers, so it is broadcast.
    """
    sample = F.broadcast(labelled_sample(labels, label, size))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    return found.dropDuplicates(["text", "label"]).select(
        "doc_id", "text", "label", (F.xxhash64("text") % 2 != 0).alias("calibrates")
    )


def _word(chunk: str) -> str:
    """A piece between white space without what surrounds its letters."""
    word = chunk.lower()
    while word and not word[0].isalnum():
        word = word[1:]
    while word and not word[-1].isalnum():
        word = word[:-1]
    return word


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes
    carrier: bytes


def build_dictionaries(words: Sequence[tuple[str, int, int]], n_toxic: int, n_ordinary: int) -> Dictionaries:
    """From words with their numbers of toxic and ordinary documents.

    A segment is a run of character grams that toxic documents have at least
    ``RATIO`` times as often as ordinary ones. Segments inside others are left out.
    """
    spaced = [(f" {word} ".encode(), toxic, ordinary) for word, toxic, ordinary in words]
    toxic_grams: Counter[bytes] = Counter()
    ordinary_grams: Counter[bytes] = Counter()
    for word, toxic, ordinary in spaced:
        for gram in {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}:
            toxic_grams[gram] += toxic
            ordinary_grams[gram] += ordinary
    # A twentieth of a small sample is as telling as LEAST_DOCUMENTS of a large one.
    least = max(3, min(LEAST_DOCUMENTS, n_toxic // 20))
    telling = {
        gram
        for gram, n in toxic_grams.items()
        if n >= least
        and n * n_ordinary >= RATIO * (ordinary_grams[gram] + 0.5) * n_toxic
    }
    segments: Counter[bytes] = Counter()
    for word, toxic, _ in spaced:
        begin = None
        for i in range(len(word) - GRAM + 2):
            inside = word[i : i + GRAM] in telling
            if inside and begin is None:
                begin = i
            elif not inside and begin is not None:
                segments[word[begin : i + GRAM - 1]] += toxic
                begin = None
    chosen: list[bytes] = []
    for segment, _ in sorted(segments.items(), key=lambda x: (-x[1], x[0])):
        if sum(map(len, chosen)) + len(segment) > SEGMENT_BYTES:
            break
        if not any(segment in other for other in chosen):
            chosen.append(segment)
    frequent = sorted(words, key=lambda x: (-x[2], x[0]))[:BASE_WORDS]
    ordinary = (" " + " ".join(word for word, _, _ in reversed(frequent)) + " ").encode()
    # The ordinary part ends both, so that its matches cost the same in both.
    return Dictionaries(ordinary, b"".join(reversed(chosen)) + ordinary, b" " + ordinary[-200:-150])


class Gains:
    """Bytes that the toxic dictionary saves on a word; each distinct word is compressed once."""

    def __init__(self, dictionaries: Dictionaries, remembered: int = 400_000):
        self.carrier = dictionaries.carrier
        self.remembered = remembered
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.ordinary = self._lengths(dictionaries.ordinary)
        self.toxic = self._lengths(dictionaries.toxic)
        self.zero = self.ordinary(self.carrier) - self.toxic(self.carrier)

    @staticmethod
    def _lengths(content: bytes):
        import zstandard as zstd

        plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        parameters = zstd.ZstdCompressionParameters(
            format=zstd.FORMAT_ZSTD1_MAGICLESS, strategy=zstd.STRATEGY_LAZY2, window_log=17,
            hash_log=16, chain_log=16, search_log=7, min_match=4, target_length=32, **plain,
        )
        # zstandard wants eight bytes at least.
        table = zstd.ZstdCompressionDict(content.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        table.precompute_compress(compression_params=parameters)
        compressor = zstd.ZstdCompressor(dict_data=table, compression_params=parameters)
        return lambda data: len(compressor.compress(data))

    def _gain(self, chunk: str) -> int:
        word = _word(chunk)
        if word not in self.words:
            window = b" " + word.encode("utf-8", "replace") + self.carrier
            gain = self.ordinary(window) - self.toxic(window) - self.zero if word else 0
            self.words[word] = min(max(gain, 0), THRESHOLDS[-1])
        return self.words[word]

    def features(self, text: str | None) -> np.ndarray:
        """Windows that reach each threshold, as logarithms, and the number of words."""
        chunks = (text or "").split()
        if len(self.known) > self.remembered:
            self.known, self.words = {}, {}
        known = self.known
        for chunk in chunks:
            if chunk not in known:
                known[chunk] = self._gain(chunk)
        gains = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        counts = np.bincount(gains, minlength=THRESHOLDS[-1] + 1)
        reached = counts[::-1].cumsum()[::-1][list(THRESHOLDS)]
        return np.log1p(np.append(reached, len(chunks)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, ridge: float = 0.1, stands_for: np.ndarray | None = None
) -> np.ndarray:
    """Weights, the constant last, of a logistic regression by Newton steps.

    ``stands_for`` is the number of rows that each row counts as, 1 by default.
    """
    n = np.ones(len(x)) if stands_for is None else stands_for
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (n * (y - p)) - penalty * weights)
        # Short steps keep it from overshooting where the classes part cleanly.
        weights += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return weights


@dataclass(frozen=True)
class ToxicityModel:
    """``dictionaries`` is null where there was nothing to learn from; then ``weights`` is the score."""

    dictionaries: Dictionaries | None
    weights: np.ndarray


def learn_toxicity(docs: DataFrame, labels: DataFrame, size: dict[int, int] = SAMPLE) -> ToxicityModel:
    """Dictionaries from one half of the sample, calibration on the other.

    The calibration weights the classes back to their shares among all labels, so the
    score stays a probability however the sample was cut. Segments are chosen by the
    shares of documents within each class, which the cut leaves as they are. The driver receives at most ``VOCABULARY`` words and one small row per text.
    """
    ready(docs.sparkSession)
    texts = sampled_texts(docs, labels, "toxic", size)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted({_word(chunk) for chunk in set(text.split())} - {""})
                columns = [pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "label"])

    counts = texts.groupBy("label", "calibrates").count().collect()
    n = {(row["label"], row["calibrates"]): row["count"] for row in counts}
    weight = sample_weights(labels, "toxic", size)
    both = [weight[y] * sum(v for (label, _), v in n.items() if label == y) for y in (0, 1)]
    if min(n.get((0, False), 0), n.get((1, False), 0), n.get((0, True), 0), n.get((1, True), 0)) == 0:
        return ToxicityModel(None, np.array([both[1] / sum(both) if sum(both) else 0.0]))
    learned = (
        texts.where(~F.col("calibrates"))
        .select("text", "label")
        .mapInArrow(words, "word string, label int")
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))
        .orderBy((F.col("toxic") + F.col("ordinary")).desc(), "word")
        .limit(VOCABULARY)
        .collect()
    )
    dictionaries = build_dictionaries(
        [(row["word"], row["toxic"], row["ordinary"]) for row in learned], n[1, False], n[0, False]
    )
    rows = _features(texts.where("calibrates"), dictionaries, F.col("label")).collect()
    x = np.array([row["features"] for row in rows])
    y = np.array([row["label"] for row in rows], float)
    stands_for = np.where(y == 1, weight[1], weight[0])
    return ToxicityModel(dictionaries, fit_logistic(x, y, stands_for=stands_for))


def _features(docs: DataFrame, dictionaries: Dictionaries, *keep: Column) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(dictionaries)
        for batch in batches:
            found = [gains.features(text).tolist() for text in batch.column(0).to_pylist()]
            columns = [*batch.columns[1:], pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "features"])

    shown = docs.select(F.col("text").alias("_text"), *keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema[1:]]
    return shown.mapInArrow(compute, ", ".join([*kinds, "features array<double>"]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *keep: Column) -> DataFrame:
    """``keep`` columns, then ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    ready(docs.sparkSession)
    if model.dictionaries is None:
        scored = docs.select(*keep, F.lit(float(model.weights[0])).alias("score"))
    else:
        found = _features(docs, model.dictionaries, *keep)
        *weights, constant = model.weights.tolist()
        terms = [F.lit(w) * F.col("features")[i] for i, w in enumerate(weights)]
        line = sum(terms, F.lit(constant))
        scored = found.select(
            *[c for c in found.columns if c != "features"], (1 / (1 + F.exp(-line))).alias("score")
        )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The toxicity of every document, learned from labels of those that are not held out."""
    learn = labels.where(~held_out(F.col("doc_id"), 5, 0))
    model = learn_toxicity(docs, learn)
    return score_toxicity(docs, model, F.col("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"))
