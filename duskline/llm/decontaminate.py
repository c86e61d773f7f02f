"""Documents that hold items of a benchmark, by BM25 with block-max WAND.

The items are cut into pieces of at most ``PIECE`` words, which an inverted index
holds with their BM25 weights, scaled so that a piece's own words score 1. Every
passage of every document is a query; passages overlap by half, so that a piece is
whole in one of them. The largest weight of each term in each block of pieces bounds
what a block can score; inside the blocks that can reach the threshold, WAND moves
to the pieces that can. An item whose parts lie in different passages need not reach
the threshold in any of them, so the shingles of all items are looked up in the whole
document besides, and no item that verification would accept is missed. Items found
are verified on the whole document: the share of their shingles that it holds, for all
of the item and for its question and its answer. The score is that of the best passage,
or of the whole document where no passage reaches the threshold.

Defined cases: null and empty texts hold nothing and items without a word are never
found; an item with fewer words than a shingle is one shingle; equal items are all
reported; a repeated document is reported each time; an empty benchmark or table
gives no rows; other columns are only passed on where they are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from duskline.llm.common import ready, saved

K1, B = 1.2, 0.75
PIECE, PASSAGE = 64, 128
THRESHOLD = 0.6
SHINGLE = 5
WHOLE_OVERLAP, PART_OVERLAP = 0.75, 0.5
# Pieces of an index that one pass over the documents carries, and in one block of it.
INDEX_PIECES, BLOCK = 512, 4
# Of the shingles' hashes; equal hashes of different shingles only cost a verification.
_FACTOR, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

LEAK = "struct<item_id:bigint,score:double,overlap:double,question:double,answer:double>"


def words_of(text: str | None) -> list[str]:
    """Words in lower case without what surrounds their letters and digits."""
    found = (_EDGES.sub("", chunk) for chunk in (text or "").lower().split())
    return [word for word in found if word]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words up to the last question mark and those after it.

    Without one, or with nothing after it, the last sentence or line is the answer,
    and of a single sentence its second half.
    """
    head, mark, tail = text.rpartition("?")
    if not (mark and words_of(tail)):
        parts = [part for part in re.split(r"(?<=[.!?])\s+|\n+", text) if words_of(part)]
        head, tail = " ".join(parts[:-1]), parts[-1] if parts else ""
    if words_of(head):
        return words_of(head), words_of(tail)
    words = words_of(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


@dataclass(frozen=True)
class Index:
    """Postings of some pieces. ``weights``: terms x pieces; ``bounds``: terms x blocks.

    ``first`` are the items whose first piece is here; only this index reports them.
    """

    terms: dict[str, int]
    weights: np.ndarray
    bounds: np.ndarray
    most: np.ndarray
    item_of: list[int]
    items: list[tuple[int | None, str]]
    first: frozenset[int]

    def block_lists(self, block: int, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Of each query term with postings in a block: pieces, weights and the largest weight."""
        begin = block * BLOCK
        part = self.weights[query, begin : begin + BLOCK]
        lists = []
        for row in part:
            at = np.flatnonzero(row)
            if len(at):
                lists.append((at + begin, row[at], float(row[at].max())))
        return lists


def wand(lists: list[tuple[np.ndarray, np.ndarray, float]], threshold: float) -> list[tuple[int, float]]:
    """Pieces that reach ``threshold``, with their scores.

    Lists are kept in order of the piece they stand at. The first list at which the
    largest weights so far reach the threshold is the pivot; lists before it jump
    to the pivot's piece, and only a piece that all of them stand at is scored.
    """
    at = [0] * len(lists)
    alive = [i for i, (pieces, _, _) in enumerate(lists) if len(pieces)]
    found = []
    while alive:
        alive.sort(key=lambda i: lists[i][0][at[i]])
        total, pivot = 0.0, None
        for place, i in enumerate(alive):
            total += lists[i][2]
            if total >= threshold:
                pivot = place
                break
        if pivot is None:
            break
        piece = lists[alive[pivot]][0][at[alive[pivot]]]
        if lists[alive[0]][0][at[alive[0]]] == piece:
            score = 0.0
            for i in alive:
                if lists[i][0][at[i]] == piece:
                    score += float(lists[i][1][at[i]])
                    at[i] += 1
            if score >= threshold:
                found.append((int(piece), score))
        else:
            for i in alive[:pivot]:
                at[i] = int(np.searchsorted(lists[i][0], piece))
        alive = [i for i in alive if at[i] < len(lists[i][0])]
    return found


def build_indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Index]:
    """Indexes of at most ``INDEX_PIECES`` pieces each, with statistics over all of them.

    Spark counts the terms. A pass carries one index, whose size is bounded; a larger
    benchmark gives more indexes.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, (name, whole) in enumerate(zip(batch["item_id"], batch["text"])):
                words = words_of(whole)
                for begin in range(0, len(words), PIECE):
                    rows.append((name, whole, begin // PIECE, words[begin : begin + PIECE]))
            yield pd.DataFrame(rows, columns=["item_id", "text", "piece", "words"])

    spark = benchmark.sparkSession
    ready(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    cut = saved(
        items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
        .distinct()
        .mapInPandas(pieces, "item_id long, text string, piece int, words array<string>"),
        "pieces",
    )
    totals = cut.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
    if not totals["n"]:
        return []
    shards = -(-totals["n"] // INDEX_PIECES)
    shard = F.pmod(F.xxhash64("item_id", "text", "piece"), F.lit(2 * shards if shards > 1 else 1))
    tf = cut.withColumn("shard", shard).select(
        "shard", "item_id", "text", "piece", F.size("words").alias("length"), F.explode("words").alias("term")
    )
    tf = tf.groupBy("shard", "item_id", "text", "piece", "length", "term").count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(totals["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / F.lit(totals["mean"]))
    weighed = saved(
        tf.join(df, "term").select(
            "shard", "item_id", "text", "piece", "term",
            (idf * F.col("count") * (K1 + 1) / (F.col("count") + norm)).alias("weight"),
        ),
        "postings",
    )
    found = []
    for row in weighed.select("shard").distinct().orderBy("shard").collect():
        table = weighed.where(F.col("shard") == row["shard"]).orderBy("item_id", "text", "piece", "term")
        found.append(_index(table.collect()))
    return found


def _index(rows: list) -> Index:
    terms: dict[str, int] = {}
    items: dict[tuple[int, str], int] = {}
    pieces: dict[tuple[int, str, int], int] = {}
    entries = []
    for row in rows:
        item = (row["item_id"], row["text"])
        items.setdefault(item, len(items))
        piece = pieces.setdefault((*item, row["piece"]), len(pieces))
        entries.append((terms.setdefault(row["term"], len(terms)), piece, row["weight"]))
    weights = np.zeros((len(terms), len(pieces)), np.float32)
    for term, piece, weight in entries:
        weights[term, piece] = weight
    weights /= weights.sum(axis=0)
    starts = np.arange(0, len(pieces), BLOCK)
    bounds = np.maximum.reduceat(weights, starts, axis=1)
    item_of = [items[item, text] for item, text, _ in pieces]
    first = frozenset(items[item, text] for item, text, number in pieces if number == 0)
    return Index(terms, weights, bounds, weights.max(axis=1), item_of, list(items), first)


def _hashes(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` word numbers from each start on."""
    found = np.zeros(len(starts), np.uint64)
    for i in range(size):
        found = found * _FACTOR + ids[starts + i].astype(np.uint64) + _ONE
    return found


@dataclass(frozen=True)
class ShingleList:
    """Sorted ``hashes`` of shingles; those of place ``i`` are in ``items[starts[i] : starts[i + 1]]``."""

    hashes: np.ndarray
    starts: np.ndarray
    items: np.ndarray


class _Known(dict):
    """What a piece of text means, found out at its first sight."""

    def __init__(self, term):
        super().__init__()
        self.term = term

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = self.term(chunk)
        return number


class Searcher:
    """Looks up documents in one index; what a piece of text between white space means is remembered."""

    def __init__(self, index: Index, threshold: float, remembered: int = 400_000):
        self.index, self.threshold, self.remembered = index, threshold, remembered
        self.known = _Known(self._term)
        self.parts: dict[int, tuple[set, set, set]] = {}
        # The index's terms, then words of its items that only pieces elsewhere hold.
        self.terms = dict(index.terms)
        self.sizes = np.ones(len(index.items))
        self.lists = self._shingle_lists()

    def _shingle_lists(self) -> dict[int, ShingleList]:
        """By number of words, the shingles of the items that this index reports."""
        parts: dict[int, tuple[list, list]] = {}
        for item in sorted(self.index.first):
            words = words_of(self.index.items[item][1])
            ids = np.array([self.terms.setdefault(word, len(self.terms)) for word in words], np.int64)
            size = min(SHINGLE, len(ids))
            own = np.unique(_hashes(ids, np.arange(len(ids) - size + 1), size))
            self.sizes[item] = len(own)
            hashes, items = parts.setdefault(size, ([], []))
            hashes.append(own)
            items.append(np.full(len(own), item))
        lists = {}
        for size, (hashes, items) in parts.items():
            every = np.concatenate(hashes)
            order = np.argsort(every, kind="stable")
            distinct, starts = np.unique(every[order], return_index=True)
            lists[size] = ShingleList(
                distinct, np.append(starts, len(every)), np.concatenate(items)[order]
            )
        return lists

    def _term(self, chunk: str) -> int:
        """The word's number, -1 for a word of no item, -2 for no word."""
        word = chunk.lower()
        if not (word[0].isalnum() and word[-1].isalnum()):
            word = _EDGES.sub("", word)
        return self.terms.get(word, -1) if word else -2

    def _held(self, ids: np.ndarray) -> list[int]:
        """Items of whose shingles the words hold enough, wherever they stand."""
        counts = np.zeros(len(self.sizes))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, shingles in self.lists.items():
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            hashes = np.unique(_hashes(ids, starts, size))
            at = np.searchsorted(shingles.hashes, hashes)
            inside = at < len(shingles.hashes)
            at, hashes = at[inside], hashes[inside]
            for i in at[shingles.hashes[at] == hashes].tolist():
                counts[shingles.items[shingles.starts[i] : shingles.starts[i + 1]]] += 1
        return np.flatnonzero(counts >= WHOLE_OVERLAP * self.sizes - 1e-9).tolist()

    def candidates(self, text: str) -> dict[int, float]:
        """Items of which some passage reaches the threshold, or whose shingles the text
        holds, with the best score."""
        chunks = text.split()
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        ids = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        ids = ids[ids != -2]
        index, best = self.index, {}
        held = self._held(ids)
        ids = np.where(ids < len(index.terms), ids, -1)
        # What terms can add at most, counted for each time they occur, bounds every passage from above.
        most = np.concatenate([[0.0], np.cumsum(np.where(ids >= 0, index.most[ids], 0.0))])
        step = PASSAGE // 2
        for begin in range(0, max(1, len(ids) - step), step):
            if most[min(begin + PASSAGE, len(ids))] - most[begin] < self.threshold:
                continue
            query = np.unique(ids[begin : begin + PASSAGE])
            query = query[query >= 0]
            bounds = index.bounds[query].sum(axis=0)
            for block in np.flatnonzero(bounds >= self.threshold - 1e-6).tolist():
                for piece, score in wand(index.block_lists(block, query), self.threshold - 1e-6):
                    item = index.item_of[piece]
                    if item in index.first:
                        best[item] = max(score, best.get(item, 0.0))
        if apart := [item for item in held if item not in best]:
            query = np.unique(ids)
            scores = index.weights[query[query >= 0]].sum(axis=0)
            for item in apart:
                best[item] = float(scores[np.array(index.item_of) == item].max())
        return best

    def leaks(self, text: str | None) -> list[dict]:
        """Verified items of a document."""
        found = []
        best = self.candidates(text or "")
        held = _shingles_of_any(words_of(text), best, self) if best else set()
        for item, score in sorted(best.items()):
            whole, question, answer = self._parts(item)
            shares = [len(part & held) / len(part) if part else 1.0 for part in (whole, question, answer)]
            if shares[0] >= WHOLE_OVERLAP and min(shares[1:]) >= PART_OVERLAP:
                names = ("overlap", "question", "answer")
                found.append(
                    {"item_id": self.index.items[item][0], "score": min(score, 1.0)}
                    | dict(zip(names, shares))
                )
        return found

    def _parts(self, item: int) -> tuple[set, set, set]:
        if item not in self.parts:
            text = self.index.items[item][1]
            question, answer = question_and_answer(text)
            self.parts[item] = (_shingles(words_of(text)), _shingles(question), _shingles(answer))
        return self.parts[item]


#: The last searcher of a worker, which the next task of the same index goes on with.
_KEPT: list[Searcher] = []


def kept_searcher(index: Index, threshold: float) -> Searcher:
    if not (_KEPT and _KEPT[0].index is index and _KEPT[0].threshold == threshold):
        _KEPT[:] = [Searcher(index, threshold)]
    return _KEPT[0]


def _shingles_of_any(words: list[str], items: dict[int, float], searcher: Searcher) -> set:
    """The shingles a document shares with some item, of every length those have."""
    wanted = set().union(*(part for item in items for part in searcher._parts(item)))
    held = set()
    for size in {len(s) for s in wanted}:
        held.update(s for s in zip(*(words[i:] for i in range(size))) if s in wanted)
    return held


def with_leaks(docs: DataFrame, benchmark: DataFrame, *keep: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of ``docs`` and ``leaks``, an array with the verified items of each row.

    A kept column named ``text`` is the documents' own text, which then goes to Python once. No shuffle: documents stay where they are, and an index of bounded size goes to
    the tasks. With several indexes each pass but the last is written down.
    """
    spark = docs.sparkSession
    ready(spark)
    indexes = build_indexes(benchmark)
    leaks = F.array().cast(f"array<{LEAK}>").alias("_leaks")
    kept = docs.select(*keep).columns
    others = [column for column, name in zip(keep, kept) if name != "text"]
    rows = docs.select(F.col("text").alias("_text"), leaks, *others)
    for number, index in enumerate(indexes):
        shared = spark.sparkContext.broadcast(index)
        kind = T.StructType.fromJson(rows.schema.jsonValue())

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = kept_searcher(shared.value, threshold)
            for batch in batches:
                texts, before = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [old + searcher.leaks(text) for text, old in zip(texts, before)]
                column = pa.array(found, batch.schema.field(1).type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), column, *batch.columns[2:]], names=batch.schema.names
                )

        rows = rows.mapInArrow(search, kind)
        if number < len(indexes) - 1:
            rows = saved(rows, "leaks")
    names = [F.col("_text").alias("text") if name == "text" else F.col(f"`{name}`") for name in kept]
    return rows.select(*names, F.col("_leaks").alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item it holds: ``doc_id, item_id, score, overlap, question, answer``."""
    found = with_leaks(docs, benchmark, F.col("doc_id"), threshold=threshold)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that hold no item."""
    found = with_leaks(docs, benchmark, *[F.col(f"`{c}`") for c in docs.columns], threshold=threshold)
    return found.where(F.size("leaks") == 0).drop("leaks")
