"""Log-probabilities of texts by a probabilistic suffix tree over words.

The states of the tree are contexts: the words before a word, up to ``DEPTH`` of them and the
start of the text among them. A context is kept if it was seen ``LEAST_COUNT`` times and the words after it
differ enough from what its longest kept shorter context expects: the summed log-likelihood
gain, that is its count times the divergence of both distributions, must reach ``GAIN`` nats.
A word is scored by the longest kept context before it. That state's distribution is smoothed
with the next shorter kept one, weighed by the number of different words seen after it; at
the root stands the base, so every state sums to one over the known words and one unknown word.

Nothing is kept whole anywhere. Texts lie in blocks as places of hashed words. In each round a
block asks, for its distinct sequences, for their counts in the whole corpus, and for its
contexts for their gains; the keys are dealt out by hash, summed, and the sums go
back to the blocks that asked, which stay where they lie. So a word, context or source that holds a third of all rows is one key per block,
and what is moved grows with the corpus. A sequence is only asked for where its context was seen
often enough, which the round before has told, as fewer can't be kept; and where its parts were asked for by other
blocks too, as else all that is to be known of it lies in the block.

Words and sequences are known by 64-bit hashes. Two sequences with one hash would share a count;
among 10^9 of them that is expected less than once.

Defined cases: a null text is empty, and an empty text is its end alone; a null document id counts as
training; a text is never cut, whatever its length, so one very long text makes one large block; repeated rows stay and count
again; without training texts the one unknown word is all there is and every score is 0; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from duskline.llm.common import held_out, in_place, ready, saved, settle

DEPTH = 2
LEAST_COUNT = 2
GAIN = 3.0
# Gains are summed in whole parts of a nat, so that no order of summing changes them.
PARTS = 1 << 16
HELD_OUT = 10, 0
# A block ends once its texts hold so many bytes.
BLOCK_BYTES = 8_000_000
# Blocks that one task goes through, about.
BUCKET_BLOCKS = 4
# Keys that are summed in one task, about.
BUCKET_KEYS = 2_000_000

BLOCK = "block long, doc_ids array<string>, held array<boolean>, lengths array<int>, hashes binary, places binary"
ASKED = "kind int, bucket int, block long, keys binary, counts binary, gains binary"
TOLD = "kind int, bucket int, block long, counts binary, gains binary, own binary, shared binary, distinct long"
SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)

START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


#: The answers to a block that asked nothing.
_NONE = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, without the high ones that all values have as 0.

    Signed values have their sign in the lowest bit.
    """
    if values.dtype.kind == "i":
        values = ((values << 1) ^ (values >> 63)).view(np.uint64)
    used = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)[:, :used]
    return bytes([used]) + planes.T.tobytes()


def _values(data: bytes, kind: str = "<u8") -> np.ndarray:
    kind = np.dtype(kind)
    used = data[0] if data else 1
    planes = np.frombuffer(data, np.uint8)[1:].reshape(used, -1)
    out = np.zeros((planes.shape[1], kind.itemsize), np.uint8)
    out[:, :used] = planes.T
    values = out.view(f"<u{kind.itemsize}").ravel()
    return values if kind.kind == "u" else (values >> np.uint64(1)).view(kind) ^ -(values & np.uint64(1)).view(kind)


def _steps(keys: np.ndarray) -> bytes:
    """Keys in order: the first one, and the steps between them, which are small where many lie in a bucket."""
    return keys[:1].tobytes() + _planes(np.diff(keys))


def _stepped(data: bytes) -> np.ndarray:
    return np.cumsum(np.r_[np.frombuffer(data, np.uint64, 1), _values(data[8:])], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of texts in the order of their first sight, each word's number from 1, words of each text.

    After the words of a text there is a 0.
    """
    # Arrow's functions for ASCII know just the letters and spaces that are meant, and leave other bytes alone.
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    words, ends = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    # A text that begins or ends with a space has an empty part there.
    real = pc.not_equal(pc.binary_length(words), 0)
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    lengths = np.diff(before[ends])
    coded = words.filter(real).dictionary_encode()
    places = np.zeros(len(coded) + len(lengths), "<u4")
    inside = np.ones(len(places), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    places[inside] = coded.indices.to_numpy() + 1
    return coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False), places, lengths


def word_blocks(docs: DataFrame, held: tuple[int, int], block_bytes: int) -> DataFrame:
    """Texts as places in the block's list of word hashes; every text ends with ``END``."""
    rows = docs.select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"),
        held_out(F.col("doc_id"), *held).alias("held"),
        F.col("text").cast("binary").alias("text"),
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        # rows of the block, and bytes of their texts
        some, size = [], 0

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(some).combine_chunks()
            words, places, lengths = _words(rows["text"].combine_chunks())
            hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, "u8")
            row = dict(block=part << 32 | seq, doc_ids=rows["doc_id"].to_pylist(), held=rows["held"].to_pylist())
            row |= dict(lengths=lengths + 1, hashes=np.r_[END, hashes].tobytes(), places=_planes(places))
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy().astype(np.int64) + 1)
            begin = before = 0
            while begin < len(sizes):
                # The text that fills the block is its last.
                end = min(int(np.searchsorted(sizes, before + block_bytes - size)) + 1, len(sizes))
                some.append(batch.slice(begin, end - begin))
                size += int(sizes[end - 1]) - before
                begin, before = end, int(sizes[end - 1])
                if size >= block_bytes:
                    yield close()
                    some, size = [], 0
                    seq += 1
        if some:
            yield close()

    schema = pa.schema(
        [("block", pa.int64()), ("doc_ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_()))]
        + [("lengths", pa.list_(pa.int32())), ("hashes", pa.binary()), ("places", pa.binary())]
    )
    return rows.mapInArrow(split, BLOCK)


class Totals:
    """What is known of the whole corpus: training tokens, their distinct ones, training texts."""

    def __init__(self, tokens: int, texts: int, distinct: int = 0):
        self.tokens, self.texts, self.distinct = tokens, texts, distinct

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))


class Sequences:
    """The distinct sequences that end at some positions of a block, in order of their keys.

    Where ``labels`` number the positions' sequences already, only the distinct ones are sorted.
    """

    def __init__(
        self, keys: np.ndarray, at: np.ndarray, alone: np.ndarray | None = None, labels: np.ndarray | None = None
    ):
        self.at, self.numbers = at, None
        if labels is None:
            order = np.argsort(keys[at])
            ordered = keys[at][order]
            new = np.r_[True, ordered[1:] != ordered[:-1]] if len(at) else np.zeros(0, bool)
            self.keys, self.first = ordered[new], at[order[new]]
            self.which = np.empty(len(at), np.int32)
            self.which[order] = np.cumsum(new, dtype=np.int32) - 1
        else:
            own = labels[at]
            some = np.full(own.max(initial=-1) + 1, -1, np.int32)
            some[own] = at
            present = np.flatnonzero(some >= 0)
            order = np.argsort(keys[some[present]])
            self.first = some[present][order]
            self.keys = keys[self.first]
            some[present[order]] = np.arange(len(order), dtype=np.int32)
            self.which = some[own]
        # Those that lie in this block alone are not asked for.
        self.alone = np.zeros(len(self.keys), bool) if alone is None else alone[self.first]

    def counted(self, training: np.ndarray) -> np.ndarray:
        return np.bincount(self.which[training[self.at]], minlength=len(self.keys))

    def filled(self, told: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What was told of the sequences asked for, and the block's own of the others."""
        out = own.copy()
        out[~self.alone] = told
        return out

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """Values of the sequences at their positions, 0 elsewhere."""
        return np.append(values, np.zeros(1, values.dtype))[self.numbered(size)]

    def numbered(self, size: int) -> np.ndarray:
        """The number of each position's sequence; one more than all of them elsewhere."""
        if self.numbers is None:
            self.numbers = self.which
            if len(self.at) < size:
                self.numbers = np.full(size, len(self.keys), np.int32)
                self.numbers[self.at] = self.which
        return self.numbers


class Block:
    """A block's words, and what each round has told about them."""

    def __init__(self, row, depth: int, least_count: int, gain: float):
        self.depth, self.least_count, self.gain = depth, least_count, gain
        distinct, self.words = np.frombuffer(row.hashes, np.uint64), _values(row.places, "<u4").view(np.int32)
        self.hashes, self.start = distinct[self.words], len(distinct)
        self.lengths = np.asarray(row.lengths, np.int64)
        self.size = len(self.hashes)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(self.size, dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.lengths)
        self.training = np.repeat(~np.asarray(row.held, bool), self.lengths)

    def _earlier(self, back: int) -> np.ndarray:
        """The word so many places before; the start of a text is a word before its first."""
        moved = np.empty_like(self.hashes)
        moved[:back], moved[back:] = START, self.hashes[: max(0, self.size - back)]
        return np.where(self.place == back - 1, START, moved)

    def _before(self, values: np.ndarray, first) -> np.ndarray:
        """Each position's value one place earlier in its text."""
        return np.where(self.place > 0, np.r_[values[:1], values[:-1]], first)

    def rounds(self, told: dict, totals: Totals, until: int) -> Iterator[tuple]:
        """What the block asks in round ``until``: ``kind, keys, counts, gains``.

        ``told`` holds the answers of the rounds before, by kind: ``2 * depth`` for the
        sequences of that depth, asked for in the round of that number, and one more for their contexts, asked
        for one round later. After the last round ``p`` holds the probability of every word.
        """
        words = Sequences(self.hashes, np.arange(self.size, dtype=np.int32), labels=self.words)
        if until == 0:
            yield _ask(0, words, words.counted(self.training))
            return
        numbers, _, shared, _ = told.pop(0, _NONE)
        counts, alone = words.spread(numbers, self.size), ~words.spread(shared, self.size)
        # What is not needed again goes at once: a block's arrays are most of a worker's memory.
        del words, numbers, shared
        self.known, self.base = counts > 0, totals.base(counts)
        p = self.base.copy()
        # Each position's sequence as a number; a context is the sequence that ends before it.
        labels = self.words
        context = np.zeros(self.size, np.uint64)
        for d in range(1, self.depth + 1):
            if until < d:
                return
            context = _mixed(context * np.uint64(0xD6E8FEB86659FD93) + self._earlier(d))
            keys = _mixed(context * np.uint64(0xA0761D6478BD642F) + self.hashes)
            seen = self._before(counts, totals.texts if d == 1 else 0)
            only = self._before(alone, False)
            at = np.flatnonzero((self.place >= d - 1) & (seen >= self.least_count)).astype(np.int32)
            found = Sequences(keys, at, alone | only)
            del keys
            own = found.counted(self.training)
            if until == d:
                yield _ask(2 * d, found, own)
                return
            numbers, owned, shared, _ = told.pop(2 * d, _NONE)
            total = found.filled(numbers, own)
            owned, shared = found.filled(owned, found.alone), found.filled(shared, ~found.alone)
            counts, alone = found.spread(total, self.size), ~found.spread(shared, self.size)
            # Of each sequence, the block that owns it tells its part of its context's gain.
            states = Sequences(context, at, only, self._before(labels, self.start))
            del only, numbers, shared, own
            labels = found.numbered(self.size)
            mine = np.flatnonzero(owned & (total > 0))
            where = states.numbered(self.size)[found.first[mine]]
            if until > d + 1:
                # What is told of the other contexts holds these parts already.
                mine, where = mine[states.alone[where]], where[states.alone[where]]
            first, n = found.first[mine], total[mine].astype(float)
            part = np.rint(n * np.log(n / seen[first] / p[first]) * PARTS)
            gains = np.bincount(where, part, len(states.keys)).astype(np.int64)
            kinds = np.bincount(where, minlength=len(states.keys))
            del found, total, owned, at, mine, first, n, where, part
            if until == d + 1:
                yield _ask(2 * d + 1, states, kinds, gains)
                continue
            numbers, _, _, sums = told.pop(2 * d + 1, _NONE)
            kinds, gains = states.filled(numbers, kinds), states.filled(sums, gains)
            kept = states.spread(gains >= self.gain * PARTS, self.size)
            kinds = states.spread(kinds, self.size)[kept]
            p[kept] = (counts[kept] + kinds * p[kept]) / (seen[kept] + kinds)
            del states, numbers, sums, kinds, gains, kept, seen
        self.p = p


def _ask(kind: int, found: Sequences, counts: np.ndarray, gains: np.ndarray | None = None) -> tuple:
    asked = ~found.alone
    sums = np.zeros(0, np.int64) if gains is None else gains[asked]
    return kind, found.keys[asked], counts[asked].astype(np.int64), sums


def _dealt(block: int, asks: Iterator[tuple], buckets: int) -> pd.DataFrame:
    """The asked keys, which are in order, cut into one row for each bucket."""
    rows = []
    for kind, keys, counts, gains in asks:
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(keys)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                row = kind, int(bucket[a]), block, _steps(keys[a:b]), _planes(counts[a:b])
                rows.append((*row, _planes(gains[a:b])))
    return pd.DataFrame(rows, columns=[kind.split()[0] for kind in ASKED.split(", ")])


def _summed(asked: pd.DataFrame) -> pd.DataFrame:
    """Sums over all blocks, for each block in the order in which it asked."""
    asked = asked.sort_values("block", ignore_index=True)
    parts = [_stepped(data) for data in asked["keys"]]
    ends = np.cumsum([len(part) for part in parts])
    keys = np.concatenate(parts)
    del parts
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[True, np.diff(keys) > 0]
    starts, group = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
    size = len(keys)
    del keys, new

    def total(values: np.ndarray) -> np.ndarray:
        out = np.empty(size, values.dtype)
        out[order] = np.add.reduceat(values[order], starts)[group]
        return out

    counts = total(np.concatenate([_values(data, "<i8") for data in asked["counts"]]))
    gains = np.concatenate([_values(data, "<i8") for data in asked["gains"]])
    gains = total(gains) if len(gains) else None
    own, shared = np.zeros(size, bool), np.empty(size, bool)
    # The first block that asked owns the key.
    own[np.minimum.reduceat(order, starts)] = True
    shared[order] = (np.diff(np.r_[starts, size]) > 1)[group]
    rows = []
    for a, b in zip(np.r_[0, ends], ends):
        told = _planes(counts[a:b]), b"" if gains is None else _planes(gains[a:b])
        rows.append((*told, np.packbits(own[a:b]).tobytes(), np.packbits(shared[a:b]).tobytes(), 0))
    frame = pd.DataFrame(rows, columns=["counts", "gains", "own", "shared", "distinct"])
    frame.loc[0, "distinct"] = int(np.count_nonzero(own & (counts > 0)))
    return pd.concat([asked[["kind", "bucket", "block"]], frame], axis=1)


def _told(rows: pd.DataFrame) -> dict:
    """Answers by kind in the order of the keys: counts, whether the block owns the key or shares it, gains."""
    told = {}
    for kind, one in rows.sort_values(["kind", "bucket"]).groupby("kind"):
        counts = [_values(data, "<i8") for data in one["counts"]]
        bits = [
            np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(c)) for o, c in zip(one[name], counts)])
            for name in ("own", "shared")
        ]
        gains = np.concatenate([_values(data, "<i8") for data in one["gains"]])
        told[kind] = np.concatenate(counts), *(b.astype(bool) for b in bits), gains
    return told


def score_texts(
    docs: DataFrame,
    held: tuple[int, int] = HELD_OUT,
    depth: int = DEPTH,
    least_count: int = LEAST_COUNT,
    gain: float = GAIN,
    block_bytes: int = BLOCK_BYTES,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Texts whose id's checksum leaves ``held[1]`` by ``held[0]`` are scored but not learned from.
    The driver receives five sums.
    """
    spark = docs.sparkSession
    ready(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = in_place(word_blocks(docs, held, block_bytes), "block", "blocks", -(-size // (BUCKET_BLOCKS * block_bytes)))
    per_text = blocks.select(F.inline(F.arrays_zip("held", "lengths")))
    sums = per_text.agg(
        F.coalesce(F.sum("lengths"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(~F.col("held"), F.col("lengths"))), F.lit(0)).alias("tokens"),
        F.count_if(~F.col("held")).alias("texts"),
    ).first()
    totals = Totals(sums["tokens"], sums["texts"])
    buckets = max(1, -(-sums["all"] // bucket_keys))

    def asks(row, told: dict, until: int) -> pd.DataFrame:
        block = Block(row, depth, least_count, gain)
        return _dealt(row.block, block.rounds(told, totals, until), buckets)

    def begin(own: pd.DataFrame) -> pd.DataFrame:
        return asks(next(own.itertuples()), {}, 0)

    def proceed(until: int):
        return lambda own, told: asks(next(own.itertuples()), _told(told), until)

    asked, tables = blocks.groupBy("block").applyInPandas(begin, ASKED), []
    for until in range(depth + 2):
        answers = asked.groupBy("kind", "bucket").applyInPandas(_summed, TOLD)
        tables.append(saved(answers, "answers"))
        del asked, answers
        settle(spark)
        if until == 0:
            words = tables[0].where("kind = 0").agg(F.coalesce(F.sum("distinct"), F.lit(0)))
            totals.distinct = words.first()[0]
        known = tables[0]
        for table in tables[1:]:
            known = known.union(table)
        told = known.select("block", "kind", "bucket", "counts", "gains", "own", "shared")
        both = blocks.groupBy("block").cogroup(told.groupBy("block"))
        if until <= depth:
            asked = both.applyInPandas(proceed(until + 1), ASKED)

    def score(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = next(own.itertuples())
        block = Block(row, depth, least_count, gain)
        for _ in block.rounds(_told(told), totals, depth + 2):
            pass
        by_text = [np.add.reduceat(x, block.starts) for x in (block.known.astype(int), np.log10(block.base), np.log10(block.p))]
        names = pd.array([None if name is None else int(name) for name in row.doc_ids], "Int64")
        frame = pd.DataFrame({"doc_id": names, "held_out": list(row.held), "n_tokens": block.lengths})
        return frame.assign(n_known=by_text[0], train_tokens=totals.tokens, base_score=by_text[1], score=by_text[2])

    return both.applyInPandas(score, SCORED)
