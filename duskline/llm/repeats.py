"""Long passages that occur more than once, found on a compacted De Bruijn graph.

The edges of the graph are the windows of ``WINDOW`` words of all texts. Windows in a row
that share their minimizer, the smallest hash among their short runs of words, form a
path and travel as one row with the hash of all its words. A repeated window has
its minimizer in common with its repeat, so paths meet by minimizer. Where all
paths of a minimizer have the same words, the graph does not branch, and the whole
path is repeated. Where they differ, paths with equal words are again repeated as a
whole, and of the others the single windows are hashed from the text at the path's
source and joined with the windows of all paths of that minimizer. Repeated
paths and windows go back to their documents by source coordinates, where they are
put together.

Defined cases: a null text has no words; texts of fewer words than a window are kept
whole; two equal rows repeat each other; rows with a null id are documents like any
other; other columns are passed on where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from duskline.llm.common import dropped, ready, saved, splittable
from duskline.llm.shingles import WORDS, mixed, split_words, windows

WINDOW = 35
# Words of the runs whose hashes are compared for the minimizer.
RUN = 10
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_MANY = 4096

PATHS = "minimizer long, words_hash long, doc_id long, text_hash int, start int, n int"


class _Powers:
    """Powers of the factor and of its inverse modulo 2 ** 64, as far as they were needed."""

    def __init__(self):
        self.up, self.down = self._of(_MANY)

    @staticmethod
    def _of(count: int) -> tuple[np.ndarray, np.ndarray]:
        both = []
        for base in (_FACTOR, _INVERSE):
            powers = np.full(count, base, np.uint64)
            powers[0] = 1
            both.append(np.cumprod(powers))
        return both[0], both[1]

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(self.up):
            self.up, self.down = self._of(2 * count)
        return self.up[:count], self.down[:count]


_POWERS = _Powers()


class Sums:
    """Hashes of any run of words of a text, from sums over its beginnings."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _POWERS.upto(len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(value + (end - start).astype(np.uint64))


def paths_of(hashes: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Minimizer, hash of all words, first window and number of windows of each path of a text.

    Of equal smallest hashes the first counts, so that equal windows have theirs at
    the same place.
    """
    count = len(hashes) - window + 1
    if count <= 0:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    runs = windows(hashes, run)
    wide = window - run + 1
    at = np.empty(count, np.int64)
    # In parts, so that a very long text needs no more memory.
    for begin in range(0, count, 1 << 16):
        end = min(begin + (1 << 16), count)
        view = np.lib.stride_tricks.sliding_window_view(runs[begin : end + wide - 1], wide)
        at[begin:end] = view.argmin(axis=1) + np.arange(begin, end)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    n = np.diff(np.concatenate([starts, [count]]))
    return runs[at[starts]], Sums(hashes).of(starts, starts + n + window - 1), starts, n


def document_paths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each path of each document. ``doc_id`` and ``text_hash`` name the document."""
    ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                found.append(paths_of(WORDS.hashed(split_words(text)), window))
            counts = [len(one[2]) for one in found]
            flat = [np.concatenate(parts) for parts in zip(*found)]
            rows = pa.array(np.repeat(np.arange(len(found)), counts))
            columns = [
                pa.array(flat[0].view(np.int64)),
                pa.array(flat[1].view(np.int64)),
                batch.column(0).take(rows),
                batch.column(1).take(rows),
                pa.array(flat[2].astype(np.int32)),
                pa.array(flat[3].astype(np.int32)),
            ]
            names = ["minimizer", "words_hash", "doc_id", "text_hash", "start", "n"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(*_key(), "text").where(F.col("text").isNotNull())
    return rows.mapInArrow(cut, PATHS)


def _key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("text_hash")]


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def _single_windows(paths: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """``minimizer, window_hash, times, doc_id, text_hash, start`` of every window of some paths.

    The paths of a document are at most as many as its words.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat: list[list[np.ndarray]] = [[], [], [], [], []]
            for row, (text, parts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                sums = Sums(WORDS.hashed(split_words(text)))
                n = np.array([p["n"] for p in parts])
                first = np.repeat(np.array([p["start"] for p in parts]), n)
                starts = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
                flat[0].append(np.repeat(np.array([p["minimizer"] for p in parts], np.int64), n))
                flat[1].append(sums.of(starts, starts + window).view(np.int64))
                flat[2].append(np.repeat(np.array([p["times"] for p in parts], np.int64), n))
                flat[3].append(starts.astype(np.int32))
                flat[4].append(np.full(len(starts), row))
            joined = [np.concatenate(part) for part in flat]
            rows = pa.array(joined[4])
            columns = [pa.array(c) for c in joined[:3]]
            columns += [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(joined[3])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["minimizer", "window_hash", "times", "doc_id", "text_hash", "start"]
    parts = paths.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("minimizer", "times", "start", "n")).alias("parts")
    )
    texts = docs.select(*_key(), "text").where(F.col("text").isNotNull())
    met = texts.join(splittable(parts), _same_document(texts, parts)).select(
        texts["doc_id"], texts["text_hash"], "text", "parts"
    )
    return met.mapInArrow(
        expand, "minimizer long, window_hash long, times long, doc_id long, text_hash int, start int"
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, start, n``: runs of ``n`` windows from word ``start`` on that are repeated."""
    paths = saved(document_paths(docs, window), "paths")
    met = paths.groupBy("minimizer").agg(
        F.count(F.lit(1)).alias("times"),
        (F.min("words_hash") != F.max("words_hash")).alias("branches"),
    )
    several = met.where(F.col("times") > 1).select("minimizer", "branches")
    hits = saved(paths.join(splittable(several), "minimizer"), "hits")
    dropped(paths)
    branching = hits.where("branches")
    source = F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("source")
    classes = saved(
        branching.groupBy("minimizer", "words_hash").agg(F.count(F.lit(1)).alias("times"), source), "classes"
    )
    names = ["doc_id", "text_hash", "start", "n"]
    equal = classes.where(F.col("times") > 1).select("minimizer", "words_hash")
    whole = hits.where(~F.col("branches")).select(names).union(
        branching.join(splittable(equal), ["minimizer", "words_hash"]).select(names)
    )
    shown = classes.select("minimizer", "times", *[F.col(f"source.{c}").alias(c) for c in names])
    single = saved(_single_windows(shown, docs, window), "windows")
    again = single.groupBy("minimizer", "window_hash").agg(F.sum("times").alias("all")).where(F.col("all") > 1)
    alone = single.where(F.col("times") == 1)
    found = alone.join(splittable(again), ["minimizer", "window_hash"])
    spans = whole.union(found.select("doc_id", "text_hash", "start", F.lit(1).alias("n")))
    gathered = saved(
        spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans"
    )
    for table in (hits, classes, single):
        dropped(table)
    return gathered


def covered(spans: list[dict] | None, n_words: int, window: int) -> np.ndarray:
    """Which words some window of the spans covers."""
    change = np.zeros(n_words + 1, np.int64)
    for span in spans or []:
        change[span["start"]] += 1
        change[span["start"] + span["n"] + window - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def without_repeats(docs: DataFrame, *keep: Column, window: int = WINDOW) -> DataFrame:
    """``keep`` columns, then ``kept_text``, ``n_words`` and ``n_removed``.

    ``kept_text`` holds the words that are left with a space between.
    """
    spark = docs.sparkSession
    ready(spark)
    spans = repeated_spans(docs, window)
    rows = docs.select(*_key(), F.col("text").alias("_text"), F.struct(*keep).alias("_keep"))
    joined = rows.join(spans, _same_document(rows, spans), "left").select("_text", "spans", "_keep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split_words(text)
                gone = covered(found, len(words), window)
                left = [word for word, out in zip(words, gone.tolist()) if not out] if found else words
                texts.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                counts.append(len(words))
                removed.append(int(gone.sum()))
            columns = [batch.column(2), pa.array(texts, pa.string())]
            columns += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_keep", "kept_text", "n_words", "n_removed"])

    shape = T.StructType(
        [joined.schema["_keep"]]
        + [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType())]
        + [T.StructField("n_removed", T.LongType())]
    )
    return joined.mapInArrow(cut, shape).select("_keep.*", "kept_text", "n_words", "n_removed")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    found = without_repeats(docs, F.col("doc_id"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
