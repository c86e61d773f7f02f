"""Hard negatives of anchors among embeddings, by lists that the anchors of a cluster share.

Anchors are dealt to clusters by direction. For a cluster, the rows of a block are sorted once by
the largest score that any anchor of the cluster can reach with them: with the angle from
the cluster's centre to the row, less the angle to the anchor farthest from the centre. Every
anchor walks that list until no later row can change its result, which the next bound
certifies. There is a walk for the positives, and one for the negatives, whose scores the positives
bound from both sides.

The anchors are a fixed part of all rows and meet all rows in blocks: a task gets at most about
``ANCHORS`` anchors, of neighbouring clusters, and ``ROWS`` rows, both dealt out by hashes of
ids, so that neither labels, clusters nor copies make a task large. Only the first few rows of an anchor leave
a task. The bounds are as good as the clusters are narrow: where anchors point in all directions, the
lists are walked nearly to the end, and the work is that of comparing all anchors with all rows.

Defined cases: rows without id, label or vector, and those with a null or non-finite component,
take no part; rows of one id count as one, the smallest by label and components; vectors are
compared with those of equal length only; zero vectors score 0 with all; ties go by the smaller id; an
anchor without positives, or with none above zero, may have no negatives; a score beyond the range of
long stops the job; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.llm.common import dropped, ready, saved

ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
# Rows and anchors that meet in one task, about.
ROWS = 16_384
ANCHORS = 2048
# Anchors that share a list.
MEMBERS = 64
# Centres are fitted on so many anchors at most; all anchors are dealt to the centres.
SAMPLE = 20_000
MOST_CENTRES = 256
ROUNDS = 8
# What rounding can do to an angle and to a bound.
ANGLE_SLACK, SLACK = 1e-7, 1e-9

FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v, size``: one row per id, with whole-numbered components."""
    component = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    bad = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    vec_id = F.col("vec_id").cast("long")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.where(known).where(~bad).select(
        vec_id.alias("vec_id"), F.struct(label.cast("long").alias("label"), component.alias("v")).alias("row")
    )
    one = rows.groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", "row.v", F.size("row.v").alias("size"))


def is_anchor() -> Column:
    return F.col("vec_id") % ANCHOR_EVERY == 0


def fit_centres(anchors: DataFrame, members: int = MEMBERS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit centres of the anchors' directions, by vector length, from a bounded sample by hash."""
    taken = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    by_size: dict[int, list] = {}
    for (v,) in taken:
        by_size.setdefault(len(v), []).append(v)
    return {size: _centres(np.array(vs, float), members) for size, vs in by_size.items() if size}


def _centres(vectors: np.ndarray, members: int) -> np.ndarray:
    units = _units(vectors)[0]
    count = min(MOST_CENTRES, -(-len(units) // members))
    centres = units[:count]
    for _ in range(ROUNDS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(lengths > 0, lengths, 1.0)[:, None], lengths


def with_cluster(anchors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``cluster``, the nearest centre, to the anchors."""
    names = ["vec_id", "label", "v", "size"]
    schema = pa.schema(
        [("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64()))]
        + [("size", pa.int32()), ("cluster", pa.int32())]
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters = [
                int((centres[len(v)] @ np.array(v, float)).argmax()) if len(v) in centres else 0
                for v in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters, pa.int32())], schema=schema)

    kinds = "vec_id long, label long, v array<long>, size int, cluster int"
    return anchors.select(*names).mapInArrow(deal, kinds)


def _meetings(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Anchors and rows with ``size, block, part``, the keys of the tasks in which they meet.

    Each row goes to one block and all parts, each anchor to one part and all blocks of its vector
    length. Parts hold neighbouring clusters; a cluster with many anchors is spread over several.
    """
    shape = rows.groupBy("size").agg(
        F.ceil(F.count(F.lit(1)) / n_rows).alias("blocks"), F.ceil(F.count_if(is_anchor()) / n_anchors).alias("parts")
    )
    sizes = anchors.groupBy("size", "cluster").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("cluster")) - F.col("n")
    placed = anchors.join(sizes.withColumn("before", before), ["size", "cluster"])
    place = F.col("before") + F.pmod(F.xxhash64("vec_id"), "n")
    parted = placed.withColumn("part", F.floor(place / n_anchors)).drop("n", "before")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    spread = parted.join(shape, "size").select(*parted.columns, blocks)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    dealt = rows.join(shape.where("parts > 0"), "size").select(
        "vec_id", "label", "v", "size", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), parts
    )
    return spread, dealt


def _matrices(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where all scores are exact in them, else Python's whole numbers."""
    a, b = np.array(left, np.int64), np.array(right, np.int64)
    largest = [int(max(m.max(), -m.min())) if m.size else 0 for m in (a, b)]
    kind = np.float64 if a.shape[1] * largest[0] * largest[1] < 2**53 else object
    return a.astype(kind), b.astype(kind)


def _first(slots, scores, ids, wanted: int):
    """The first rows of each slot: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, slots))
    slots, scores, ids = slots[order], scores[order], ids[order]
    starts = np.r_[True, slots[1:] != slots[:-1]] if len(slots) else np.zeros(0, bool)
    rank = np.arange(len(slots)) - np.maximum.accumulate(np.where(starts, np.arange(len(slots)), 0))
    kept = rank < wanted
    return slots[kept], scores[kept], ids[kept], rank[kept]


def walk(members, slots, rows, wanted: int):
    """What each slot finds in the block: ``slot, score, vec_id``, at most ``wanted`` a slot.

    ``members``: matrix and ids of a cluster's anchors. ``slots``: per slot its member, label, whether
    that label is sought or shunned, and the least and largest score. ``rows``: matrix, labels, ids.
    """
    matrix, own = members
    member, label, same, least, most = slots
    vectors, labels, ids = rows
    units, lengths = _units(matrix.astype(float))
    row_units, row_lengths = _units(vectors.astype(float))
    centre = units.sum(axis=0)
    size = np.linalg.norm(centre)
    bound = row_lengths
    if size > 0:
        centre = centre / size
        spread = np.arccos(np.clip(units[lengths > 0] @ centre, -1, 1)).max(initial=0.0)
        angle = np.arccos(np.clip(row_units @ centre, -1, 1)) - spread - ANGLE_SLACK
        bound = row_lengths * np.cos(np.maximum(angle, 0.0))
    order = np.argsort(-bound, kind="stable")

    none = np.zeros(0, np.int64)
    found = none, matrix[:0, :0].ravel(), none
    last = np.full(len(member), -np.inf)
    active = least <= most
    at, step = 0, 1024
    while at < len(order) and active.any():
        chunk = order[at : at + step]
        walking = np.flatnonzero(active)
        used, which = np.unique(member[walking], return_inverse=True)
        scores = (matrix[used] @ vectors[chunk].T)[which]
        good = (labels[chunk][None, :] == label[walking][:, None]) == same
        good &= ids[chunk][None, :] != own[member[walking]][:, None]
        floor = np.maximum(least[walking], last[walking])[:, None]
        good &= (scores >= floor).astype(bool) & (scores <= most[walking][:, None]).astype(bool)
        slot, row = np.nonzero(good)
        new = walking[slot], scores[slot, row], ids[chunk[row]]
        *found, rank = _first(*(np.concatenate(pair) for pair in zip(found, new)), wanted)
        full = rank == wanted - 1
        last[found[0][full]] = found[1][full].astype(float)
        at, step = at + step, min(step * 2, 8192)
        if at < len(order):
            # A score equal to the last one may still win by its id.
            reach = bound[order[at]] * lengths[member]
            reach = reach + SLACK * (1 + row_lengths.max()) * (1 + lengths[member])
            active &= (reach >= last) & (reach >= least)
    return found


def _clusters(anchors: pd.DataFrame, members: int) -> Iterator[np.ndarray]:
    """Places of the anchors that share a list; large clusters are cut."""
    for _, one in anchors.sort_values(["cluster", "vec_id"]).groupby("cluster").indices.items():
        for start in range(0, len(one), members):
            yield one[start : start + members]


def _met(anchors: DataFrame, rows: DataFrame, find, kinds: str) -> DataFrame:
    keys = ["size", "block", "part"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.zeros(0, np.int64),) * len(names)]
        if len(left) and len(right):
            left = left.sort_values(["cluster", "vec_id"], ignore_index=True)
            matrix, vectors = _matrices([list(v) for v in left["v"]], [list(v) for v in right["v"]])
            block = vectors, right["label"].to_numpy(), right["vec_id"].to_numpy()
            for places in _clusters(left, MEMBERS):
                parts.append(find(left.iloc[places], matrix[places], block))
        return pd.DataFrame({n: np.concatenate(p).astype(np.int64) for n, p in zip(names, zip(*parts))})

    names = [kind.split()[0] for kind in kinds.split(", ")]
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, kinds)


def positives(rows: DataFrame, anchors: DataFrame, wanted: int = POSITIVES) -> DataFrame:
    """``anchor_id, positive_id, positive_score``: the first rows of each anchor's label."""

    def find(left: pd.DataFrame, matrix: np.ndarray, block):
        own, n = left["vec_id"].to_numpy(), len(left)
        unbound = np.full(n, -np.inf), np.full(n, np.inf)
        slots = np.arange(n), left["label"].to_numpy(), True, *unbound
        slot, score, ids = walk((matrix, own), slots, block, wanted)
        return own[slot], ids, score

    local = _met(anchors, rows, find, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return local.withColumn("place", place).where(F.col("place") <= wanted).drop("place")


def negatives(rows: DataFrame, anchors: DataFrame, wanted: int = NEGATIVES) -> DataFrame:
    """The first rows of other labels between each positive's score and four fifths of it.

    ``anchors`` hold ``positives``, a list of ``(positive_id, positive_score)``.
    """

    def find(left: pd.DataFrame, matrix: np.ndarray, block):
        own = left["vec_id"].to_numpy()
        pairs = [(i, p["positive_id"], p["positive_score"]) for i, ps in enumerate(left["positives"]) for p in ps]
        member, positive, most = (np.array(column, np.int64) for column in zip(*pairs))
        # 80 p <= 100 n, in whole numbers
        least = -(-most * 4 // 5)
        label = left["label"].to_numpy()[member]
        slots = member, label, False, least.astype(matrix.dtype), most.astype(matrix.dtype)
        slot, score, ids = walk((matrix, own), slots, block, wanted)
        return own[member[slot]], positive[slot], ids, most[slot], score

    kinds = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    local = _met(anchors, rows, find, kinds)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    return ranked.select(*[kind.split()[0] for kind in FOUND.split(", ")])


def hard_negatives(vectors: DataFrame, n_rows: int = ROWS, n_anchors: int = ANCHORS) -> DataFrame:
    """Per anchor, positive and ``rank``: a hard negative, with both scores."""
    ready(vectors.sparkSession)
    rows = saved(whole_vectors(vectors), "vectors")
    chosen = rows.where(is_anchor())
    anchors = saved(with_cluster(chosen, fit_centres(chosen)), "anchors")
    spread, dealt = _meetings(rows, anchors, n_rows, n_anchors)
    known = saved(positives(dealt, spread), "positives")
    pairs = F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives")
    held = saved(
        anchors.join(known.groupBy(F.col("anchor_id").alias("vec_id")).agg(pairs), "vec_id"), "anchors"
    )
    dropped(anchors)
    dropped(known)
    spread, dealt = _meetings(rows, held, n_rows, n_anchors)
    return negatives(dealt, spread)
