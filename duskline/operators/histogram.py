"""Histograms with equal bins over the range of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duskline.operators import filters
from duskline.operators.profile import row_count


def histogram(df: DataFrame, column: str, bins: int, weight: str | None = None) -> DataFrame:
    """Rows ``(bin, lower, upper, n)``; the last bin holds the maximum, empty bins 0.

    The data is read once, into counts per value. The edges are a scalar subquery
    over those counts, so both share one shuffle. A single value gets a range of
    one around it.
    """
    values = (
        df.select(F.col(column).cast("double").alias("x"), *([weight] if weight else []))
        .where(F.col("x").isNotNull())
        .groupBy("x")
        .agg(row_count(weight).alias("n"))
    )
    edges = values.agg(_edges(bins).alias("edges")).scalar()
    reached = F.filter("edges", lambda edge: edge <= F.col("x"))
    counts = (
        values.withColumn("edges", edges)
        .select("n", (F.least(F.size(reached), F.lit(bins)) - 1).alias("bin"))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    # At most ``bins`` rows on either side.
    numbers = df.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return numbers.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        F.get(edges, F.col("bin")).alias("lower"),
        F.get(edges, F.col("bin") + 1).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _edges(bins: int) -> Column:
    """``bins + 1`` edges, null without rows.

    The test on ``n`` keeps Catalyst from dropping the grouping and reading the
    data a second time.
    """
    spread = F.when(F.min("x") == F.max("x"), 0.5).otherwise(0.0)
    low, high = F.min("x") - spread, F.max("x") + spread
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(bins)),
        lambda i: F.when(i == bins, high).otherwise(low + i * ((high - low) / bins)),
    )
    return F.when(F.sum("n") > 0, steps)


def age_histogram(df: DataFrame, bins: int = 20, weight: str | None = None) -> DataFrame:
    return histogram(filters.known_age(df), "subject_age", bins, weight)


def date_histogram(df: DataFrame, bins: int = 10, weight: str | None = None) -> DataFrame:
    """Bin edges in days since 1970-01-01."""
    days = df.withColumn("day", F.unix_date("date"))
    return histogram(days, "day", bins, weight)
