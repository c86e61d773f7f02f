"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duskline.llm.common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``a``, ``b``: long): the smallest node reachable.

    Every round gives a node, and the node its label points to, the smallest label
    among its neighbours, and then follows labels one step, so the number of rounds
    grows with the logarithm of the longest path. Rounds are written to the shared
    folder. Only minima by node are shuffled after a partial aggregate; the join with
    the labels has two plain tables, so AQE can split a node with many edges.
    Loops, repeated edges and edges with a null end are ignored.
    """
    named = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    known = named.where(F.col("a") != F.col("b"))
    both = saved(
        known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = saved(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.col("a")).alias("component")
        ),
        "labels",
    )
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).select("a", "component")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        # A row for the node itself and one for the node its label points to.
        told = labels.join(near, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("node"), F.least("near", "component").alias("label")),
                    F.struct(F.col("component").alias("node"), F.least("near", "component").alias("label")),
                )
            ).alias("r")
        )
        lowered = told.groupBy(F.col("r.node").alias("node")).agg(F.min("r.label").alias("label"))
        hooked = saved(lowered, "labels")
        target = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = hooked.join(target, "label").select("node", F.col("further").alias("component"))
        after = saved(jumped, "labels")
        old = labels.select("node", F.col("component").alias("before"))
        changed = after.join(old, "node").where(F.col("component") != F.col("before"))
        done = changed.isEmpty()
        dropped(hooked)
        dropped(labels)
        labels = after
        if done:
            dropped(both)
            return labels
