"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least ``threshold`` lie within a distance epsilon.
They are sorted by the cells of a grid of that width over the leading principal
directions, and the sequence is cut into intervals with bounding boxes. Pairs of
intervals are refined from the whole sequence downwards; a pair whose boxes are
further apart than epsilon is dropped with all that lies below it. What is left is
compared by cosine in double precision.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components
or have another length than most vectors, and rows with a null id, link with
nothing; equal vectors are one class and link with each other; a repeated id counts
as often as it occurs; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.llm.common import dropped, ready, saved
from duskline.llm.components import components

THRESHOLD = 0.9
# Principal directions are fitted on at most so many vectors.
SAMPLE = 20_000
DIRECTIONS = 8
# Vectors in an interval that travels, and in the smallest that is compared.
INTERVAL, LEAF = 2048, 256
FAN_OUT = 8
# Room for rounding when boxes are compared and cosines prepared.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, and not zero."""

    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    good = F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def _directions(classes: DataFrame, count: int) -> np.ndarray:
    """Leading principal directions of a bounded sample, as columns."""
    rows = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vector").collect()
    x = np.array([row["vector"] for row in rows], dtype=np.float64)
    x = _unit(x)
    _, directions = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))
    return directions[:, ::-1][:, :count]


def _unit(x: np.ndarray) -> np.ndarray:
    # By the largest component first, so that no square over- or underflows.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _intervals(classes: DataFrame, directions: np.ndarray, epsilon: float, kind: str) -> DataFrame:
    """The sequence in grid order, cut into rows of at most ``INTERVAL`` vectors.

    Columns: ``part, seq, low, high`` (box over the directions), ``reps``, ``sizes``,
    and ``data``, the components as they came (``kind``).
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(np.array(batch.column("vector").to_pylist(), dtype=np.float64))
            cells = np.floor(x @ directions / epsilon).astype(np.int32)
            column = pa.array(cells.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column], names=[*batch.schema.names, "cells"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        reps: list[int] = []
        sizes: list[int] = []
        vectors: list[list[float]] = []

        def close() -> pa.RecordBatch:
            x = np.array(vectors, dtype=np.float64)
            at = _unit(x) @ directions
            row = dict(part=part, seq=seq, low=at.min(0).tolist(), high=at.max(0).tolist())
            row |= dict(reps=reps, sizes=sizes, data=x.astype(kind).tobytes())
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("rep", "size", "vector")))
            for rep, size, vector in rows:
                reps.append(rep)
                sizes.append(size)
                vectors.append(vector)
                if len(reps) == INTERVAL:
                    yield close()
                    reps, sizes, vectors, seq = [], [], [], seq + 1
        if reps:
            yield close()

    box, numbers = pa.list_(pa.float64()), pa.list_(pa.int64())
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("low", box), ("high", box)]
        + [("reps", numbers), ("sizes", numbers), ("data", pa.binary())]
    )
    placed = classes.mapInArrow(place, "rep long, size long, vector array<double>, cells array<int>")
    count = max(1, math.ceil(classes.count() / INTERVAL))
    kinds = "part int, seq int, low array<double>, high array<double>"
    return (
        placed.repartitionByRange(count, "cells", "rep")
        .sortWithinPartitions("cells", "rep")
        .mapInArrow(cut, kinds + ", reps array<long>, sizes array<long>, data binary")
    )


def _close(epsilon: float) -> Column:
    """Whether boxes ``a_low..a_high`` and ``b_low..b_high`` are within epsilon."""
    gaps = F.zip_with(
        F.zip_with("a_low", "b_high", lambda a, b: a - b),
        F.zip_with("b_low", "a_high", lambda b, a: b - a),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    square = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    return square <= epsilon * epsilon + SLACK


def _near_intervals(boxes: DataFrame, count: int, epsilon: float) -> DataFrame:
    """``a, b`` (a <= b) of intervals whose boxes are within epsilon, found from the top down.

    A node of level k stands for ``FAN_OUT ** k`` intervals in a row. A level's
    pairs are joined with the children of both sides and only near ones go on.
    """
    levels = [boxes]
    while count > 1:
        above = levels[-1].withColumn("node", F.floor(F.col("node") / FAN_OUT))
        size = range(DIRECTIONS)
        low = F.array(*[F.min(F.get("low", F.lit(i))) for i in size])
        high = F.array(*[F.max(F.get("high", F.lit(i))) for i in size])
        # A box has as many sides as there are directions, which may be fewer than DIRECTIONS.
        merged = above.groupBy("node").agg(low.alias("low"), high.alias("high"))
        known = [F.filter(c, lambda x: x.isNotNull()).alias(c) for c in ("low", "high")]
        levels.append(merged.select("node", *known))
        count = math.ceil(count / FAN_OUT)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("parent", F.floor(F.col("node") / FAN_OUT))
        left = child.select(*[F.col(c).alias(f"a_{c}") for c in child.columns])
        right = child.select(*[F.col(c).alias(f"b_{c}") for c in child.columns])
        pairs = (
            pairs.join(left, F.col("a") == F.col("a_parent"))
            .join(right, (F.col("b") == F.col("b_parent")) & (F.col("a_node") <= F.col("b_node")))
            .where(_close(epsilon))
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        )
    return pairs


def _compare(
    left: np.ndarray,
    right: np.ndarray,
    same: bool,
    directions: np.ndarray,
    epsilon: float,
    threshold: float,
) -> np.ndarray:
    """Which of ``left`` link with which of ``right``; leaves too far apart are skipped."""
    linked = np.zeros((len(left), len(right)), bool)
    a, b = _unit(left), _unit(right)

    def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, starts = x @ directions, np.arange(0, len(x), LEAF)
        return np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)

    (a_low, a_high), (b_low, b_high) = boxes(a), boxes(b)
    gap = np.maximum(0, np.maximum(a_low[:, None] - b_high[None], b_low[None] - a_high[:, None]))
    for i, j in zip(*np.nonzero((gap**2).sum(axis=2) <= epsilon**2 + SLACK)):
        if same and j < i:
            continue
        rows, columns = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        cosine = a[rows] @ b[columns].T
        found = cosine >= threshold
        for r, c in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12)):
            # So near the bound that the order of the sum matters: the sum without rounding.
            found[r, c] = _exact_cosine(left[rows][r], right[columns][c]) >= threshold
        linked[rows, columns] = found
        if same and i != j:
            linked[columns, rows] = found.T
    if same:
        np.fill_diagonal(linked, False)
    return linked


def _exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    dot = math.fsum((x * y).tolist())
    return dot / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


def _roots(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per row and per column the first row of its component, or -1 without a link."""
    far = np.iinfo(np.int32).max
    rows = np.where(linked.any(axis=1), np.arange(len(linked), dtype=np.int32), far)
    while True:
        columns = np.where(linked, rows[:, None], far).min(axis=0)
        again = np.minimum(rows, np.where(linked, columns[None], far).min(axis=1))
        if same:
            again = np.minimum(again, np.where(again < far, columns, far))
        if (again == rows).all():
            return np.where(rows < far, rows, -1), np.where(columns < far, columns, -1)
        rows = again


def _links(
    pairs: DataFrame,
    intervals: DataFrame,
    directions: np.ndarray,
    epsilon: float,
    threshold: float,
    kind: str,
) -> DataFrame:
    """Rows ``rep, links, root``: links found in one pair of intervals, and a node it hangs together with."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["a"] == row["b"]
                x, y = (
                    np.frombuffer(row[f"{side}_data"], kind)
                    .reshape(len(row[f"{side}_reps"]), -1)
                    .astype(np.float64)
                    for side in "ab"
                )
                linked = _compare(x, y, same, directions, epsilon, threshold)
                first, second = _roots(linked, same)
                sides = [(linked, row["a_reps"], row["b_sizes"], first)]
                if not same:
                    sides.append((linked.T, row["b_reps"], row["a_sizes"], second))
                for found, reps, sizes, roots in sides:
                    own = np.flatnonzero(roots >= 0)
                    links = found[own] @ np.array(sizes)
                    columns = [np.array(reps)[own], links, np.array(row["a_reps"])[roots[own]]]
                    if len(own):
                        arrays = [pa.array(c.astype(np.int64)) for c in columns]
                        yield pa.RecordBatch.from_arrays(arrays, names=["rep", "links", "root"])

    def side(name: str) -> DataFrame:
        return intervals.select(
            F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("reps", "sizes", "data")]
        )

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(compare, "rep long, links long, root long")


def linked_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept``.

    The widest thing that is written is the table of classes; a task sends one row
    for each linked vector of a pair of intervals, never the pairs themselves.
    """
    ready(vectors.sparkSession)
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = good.groupBy(F.size("embedding").alias("length")).count()
    usual = lengths.orderBy(F.col("count").desc(), "length").first()
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
    if usual is None:
        return rows.select("vec_id", *alone, F.lit(True).alias("kept"))
    good = good.where(F.size("embedding") == usual["length"])
    classes = saved(
        good.groupBy("embedding")
        .agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("size"))
        .select("embedding", "rep", "size"),
        "classes",
    )
    numbers = classes.select("rep", "size", F.col("embedding").cast("array<double>").alias("vector"))
    directions = _directions(numbers, min(DIRECTIONS, usual["length"]))
    kind = "<f4" if "float" in dict(classes.dtypes)["embedding"] else "<f8"
    cut = _intervals(numbers, directions, epsilon, kind)
    # One row per INTERVAL vectors, so the window over all of them is short.
    cut = saved(cut, "intervals")
    order = Window.orderBy("part", "seq")
    number = cut.select("part", "seq", "low", "high").withColumn("node", F.row_number().over(order) - 1)
    boxes = saved(number.withColumn("node", F.col("node").cast("long")), "boxes")
    intervals = cut.drop("low", "high").join(boxes.select("part", "seq", "node"), ["part", "seq"])
    pairs = _near_intervals(boxes.select("node", "low", "high"), boxes.count(), epsilon)
    links = saved(_links(pairs, intervals, directions, epsilon, threshold, kind), "links")
    dropped(cut)
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = (
        classes.join(counts, "rep", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("embedding").alias("known"),
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    by_class = saved(merged, "classes")
    in_class = (rows["embedding"] == by_class["known"]) & rows["vec_id"].isNotNull()
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return rows.join(by_class, in_class, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
