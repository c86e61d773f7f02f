"""Near-duplicate documents by bottom-k sketches of word shingles, verified exactly.

The sketch of a document is the ``SKETCH`` smallest of its shingles' hashes. Documents with
the same set are one class. Inverted lists of the values that a class retains and
shares find candidates: two linked classes share at least ``least_common`` values, so
they meet in a list of the rarest values of both, and frequent passages make no
lists. The class of a list that shares most is its leader; all lists of a leader form
one group. Members are compared with their leader first. Where a group then still
has several components, the members outside the leader's are compared with the rest,
in chunks. An estimate from the union of the two sketches filters, and full sets decide.

The only chance in it: linked sets must agree in ``least_common`` of 64 retained
values and reach ``ESTIMATE`` in the estimate, each six standard deviations below
what is expected at the threshold.

Defined cases: texts that are null or have no word have an empty set and link with
nothing; fewer words than a shingle are one shingle; rows with a null id link with
nothing and are kept; rows with one id are one document (of several texts the first
in order is compared); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.common import dropped, ready, saved, splittable
from duskline.llm.components import components
from duskline.llm.shingles import shingle_set

SHINGLE = 5
SKETCH = 64
# Shares of 100: linked are sets with PER * intersection >= LEAST * union.
PER, LEAST = 100, 75
LEAST_COMMON = 27
ESTIMATE = 0.43
# Members of a chunk, on average. Two chunks are compared in one task.
CHUNK = 192
_COLUMNS = 4096


def least_common(n: Column) -> Column:
    """Retained values that a set of ``n`` shingles shares with any linked one.

    Small sets are retained whole by both sides, which makes the bound exact.
    """
    whole = F.ceil(n * LEAST / PER)
    return F.when(n * PER <= SKETCH * LEAST, whole).otherwise(F.lit(LEAST_COMMON)).cast("int")


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, signature, sketch``; the signature is 128 bits of the whole set."""
    ready(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, signatures, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, SHINGLE)
                counts.append(len(found))
                signatures.append(_signature(found) if len(found) else None)
                sketches.append(found[:SKETCH].view(np.int64))
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(signatures, pa.binary()),
                pa.array(sketches, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_shingles", "signature", "sketch"]
    kinds = "doc_id long, n_shingles long, signature binary, sketch array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sets, kinds)


def _signature(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def grouped_candidates(classes: DataFrame) -> DataFrame:
    """``leader, member``: members of each leader's group, the leader left out.

    Values that no other class retains make no list; they only count against the
    length of the prefix. Lists are joined with their leader, not with themselves.
    """
    values = classes.select("rep", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > 1)
    shared = values.join(splittable(often), "value")
    found = F.sort_array(F.collect_list(F.struct("often", "value"))).alias("found")
    by_class = shared.groupBy("rep", "n").agg(found).withColumn("common", F.size("found"))
    length = F.col("common") - least_common(F.col("n")) + 1
    prefixes = saved(
        by_class.where(length > 0).select(
            "rep", "common", F.transform(F.slice("found", 1, length), lambda x: x["value"]).alias("kept")
        ),
        "prefixes",
    )
    entries = prefixes.select("rep", "common", F.explode("kept").alias("value"))
    best = F.max(F.struct("common", (-F.col("rep")).alias("less")))
    leaders = (
        entries.groupBy("value")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("value", (-F.col("best.less")).alias("leader"))
    )
    met = entries.join(splittable(leaders), "value").where(F.col("rep") != F.col("leader"))
    members = saved(met.select("leader", F.col("rep").alias("member")).distinct(), "members")
    dropped(prefixes)
    return members


def _estimated(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard of each pair from the sketches, over values that both would have retained."""
    both = _intersections([x[:SKETCH] for x in a], [x[:SKETCH] for x in b])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)

    def reach(x: list[np.ndarray]) -> np.ndarray:
        return np.array([s[SKETCH - 1] if len(s) >= SKETCH else top for s in x], np.uint64)

    a_reach, b_reach = reach(a), reach(b)

    def reached(x: list[np.ndarray], own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Values of each sketch up to where both sketches of a pair reach."""
        ends = [np.searchsorted(s[:SKETCH], np.minimum(r, other), "right") for s, r in zip(x, own)]
        return np.array(ends)

    in_a, in_b = reached(a, a_reach, b_reach), reached(b, b_reach, a_reach).T
    return both / np.maximum(in_a + in_b - both, 1)


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    total = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return total

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        kept = shared[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[kept], at[kept]

    (rows_a, at_a), (rows_b, at_b) = places(a, flat_a), places(b, flat_b)
    for begin in range(0, len(shared), _COLUMNS):
        width = min(_COLUMNS, len(shared) - begin)
        parts = []
        for rows, at, count in ((rows_a, at_a, len(a)), (rows_b, at_b, len(b))):
            inside = (at >= begin) & (at < begin + width)
            part = np.zeros((count, width), np.float32)
            part[rows[inside], at[inside] - begin] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``a`` are linked with which of ``b``; the estimate spares most full comparisons."""
    linked = np.zeros((len(a), len(b)), bool)
    likely = _estimated(a, b) >= ESTIMATE
    rows, columns = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
    if len(rows):
        some_a, some_b = [a[i] for i in rows], [b[j] for j in columns]
        both = _intersections(some_a, some_b).astype(np.int64)
        sizes = np.array([len(s) for s in some_a])[:, None] + np.array([len(s) for s in some_b])
        good = PER * both >= LEAST * (sizes - both)
        linked[np.ix_(rows, columns)] = good & likely[np.ix_(rows, columns)]
    return linked


def _star_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: members that link with their leader."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
            found = []
            for leader, member, leader_text, member_text in zip(*columns):
                if last[0] != leader_text:
                    last = (leader_text, shingle_set(leader_text, SHINGLE))
                found.append(bool(linked_pairs([last[1]], [shingle_set(member_text, SHINGLE)])[0, 0]))
            kept = pa.array(found, pa.bool_())
            pairs = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])
            yield pairs.filter(kept)

    def side(name: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"{name}_text"))

    both = members.join(side("member"), "member").join(side("leader"), "leader")
    return both.select("leader", "member", "leader_text", "member_text").mapInArrow(
        verify, "a long, b long"
    )


def _remaining_links(members: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """``a, b``: links between components of a group, enough to connect what is linked.

    Home are the members in the leader's component. Those outside are compared with
    home and with each other; home is not compared with itself again.
    """
    everyone = members.union(members.select("leader", F.col("leader").alias("member")).distinct())
    label = found.select(F.col("node").alias("member"), "component")
    placed = everyone.join(splittable(label), "member", "left").withColumn(
        "component", F.coalesce("component", "member")
    )
    of_leader = found.select(F.col("node").alias("leader"), F.col("component").alias("home_component"))
    home = F.col("component") == F.coalesce("home_component", "leader")
    placed = saved(
        placed.join(splittable(of_leader), "leader", "left").select(
            "leader", "member", "component", home.alias("home")
        ),
        "placed",
    )

    def chunks(rows: Column) -> Column:
        return F.ceil(rows / CHUNK).cast("int")

    sizes = (
        placed.groupBy("leader")
        .agg(
            F.count(F.when(F.col("home"), 1)).alias("n_home"),
            F.count(F.when(~F.col("home"), 1)).alias("n_out"),
        )
        .where(F.col("n_out") > 0)
        .select(
            "leader",
            chunks(F.col("n_home")).alias("homes"),
            chunks(F.col("n_out")).alias("outs"),
        )
    )
    own = F.pmod(F.xxhash64("member"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("outs"))).cast("int")
    rows = placed.join(splittable(sizes), "leader").withColumn("own", own)
    outs = F.sequence(F.lit(0), F.col("outs") - 1)
    homes = F.sequence(F.lit(0), F.col("homes") - 1)

    def pair(left: Column, right: Column, with_home: bool) -> Column:
        return F.struct(F.lit(with_home).alias("with_home"), left.alias("i"), right.alias("j"))

    to_home = F.transform(homes, lambda i: pair(i, F.col("own"), True))
    among = F.transform(outs, lambda j: pair(F.least(j, F.col("own")), F.greatest(j, F.col("own")), False))
    met = F.when(F.col("home"), F.transform(outs, lambda j: pair(F.col("own"), j, True))).otherwise(
        F.concat(to_home, among)
    )
    dealt = rows.select("leader", "member", "component", "home", "own", F.explode(met).alias("pair"))
    dealt = dealt.join(texts.withColumnRenamed("doc_id", "member"), "member")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        pair_of = group["pair"].iloc[0]
        if pair_of["with_home"]:
            first, second = group[group["home"]], group[~group["home"]]
        else:
            first, second = group[group["own"] == pair_of["i"]], group[group["own"] == pair_of["j"]]
        edges = []
        if len(first) and len(second):
            a, b = ([shingle_set(t, SHINGLE) for t in side["text"]] for side in (first, second))
            linked = linked_pairs(a, b)
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            ids = first["member"].tolist(), second["member"].tolist()
            labels = first["component"].tolist(), second["component"].tolist()
            for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
                x, y = root(labels[0][i]), root(labels[1][j])
                if x != y:
                    parent[x] = y
                    edges.append((ids[0][i], ids[1][j]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("leader", "pair").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    sets = saved(document_sets(docs), "sets")
    good = sets.where(F.col("doc_id").isNotNull() & F.col("signature").isNotNull())
    classes = saved(
        good.groupBy("signature").agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    members = grouped_candidates(classes)
    wanted = members.select(F.explode(F.array("leader", "member")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = saved(
        texts.join(splittable(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "texts"
    )
    # Several classes under one id are one document.
    star = saved(_star_links(members, texts), "star")
    first = components(star)
    rest = saved(_remaining_links(members, texts, first), "rest")
    found = components(star.union(rest))
    for table in (members, texts, star, rest, first):
        dropped(table)
    named = found.withColumnRenamed("node", "rep")
    by_set = saved(
        classes.join(named, "rep", "left").select(
            F.col("signature").alias("known"), F.coalesce("component", "rep").alias("component")
        ),
        "by_set",
    )
    dropped(classes)
    component = F.coalesce("component", "doc_id")
    return sets.join(by_set, F.col("signature") == F.col("known"), "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
