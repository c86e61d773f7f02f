"""Bringing city tables with differing columns to one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from duskline.fixed import ROW_NUMBER, STOP_COLUMNS


def column_inventory(
    spark: SparkSession, sources: Mapping[str, DataFrame], hidden: str = "raw"
) -> DataFrame:
    """Which sources hold each column, in source order; reads schemas only."""
    return inventory_of_columns(spark, {source: df.columns for source, df in sources.items()}, hidden)


def inventory_of_columns(
    spark: SparkSession, columns: Mapping[str, Sequence[str]], hidden: str = "raw"
) -> DataFrame:
    """The same from the columns of each source."""
    cells = [
        (name, position, source)
        for position, (source, names) in enumerate(columns.items())
        for name in names
    ]
    listed = spark.createDataFrame(cells, "column_name string, position int, source string")
    return _sources_per_column(listed.where(~F.contains("column_name", F.lit(hidden))))


def filled_inventory(sources: Mapping[str, DataFrame], hidden: str = "raw") -> DataFrame:
    """The inventory with the number of non-null values over all sources.

    One narrow aggregate per source; no rows are shuffled.
    """
    listed = [
        non_null_counts(df).select(
            "column_name",
            F.lit(position).alias("position"),
            F.lit(source).alias("source"),
            "non_null",
        )
        for position, (source, df) in enumerate(sources.items())
    ]
    cells = reduce(DataFrame.unionByName, listed)
    return _sources_per_column(
        cells.where(~F.contains("column_name", F.lit(hidden))),
        F.sum("non_null").alias("non_null"),
    )


def _sources_per_column(cells: DataFrame, *extra) -> DataFrame:
    """The lists are as long as the number of sources, whatever their size."""
    found = F.sort_array(F.collect_list(F.struct("position", "source")))
    return cells.groupBy("column_name").agg(found["source"].alias("sources"), *extra)


def non_null_counts(df: DataFrame) -> DataFrame:
    """Rows ``(column_name, non_null)`` from one pass over the table."""
    counts = df.agg(*[F.count(F.col(f"`{name}`")).alias(name) for name in df.columns])
    return counts.unpivot(
        [], [F.col(f"`{name}`") for name in df.columns], "column_name", "non_null"
    )


def add_missing_columns(df: DataFrame, wanted: Sequence[str] = STOP_COLUMNS) -> DataFrame:
    """Wanted columns the table lacks, as nulls."""
    missing = [name for name in wanted if name not in df.columns]
    return df.withColumns({name: F.lit(None).cast("string") for name in missing})


def tag_city(df: DataFrame, city: str) -> DataFrame:
    return df.withColumn("city", F.lit(city))


def union_shared(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, duplicates kept, of the columns every frame has."""
    first, *others = frames
    shared = [name for name in first.columns if all(name in df.columns for df in others)]
    parts = [df.select(*[F.col(f"`{name}`") for name in shared]) for df in frames]
    return reduce(DataFrame.unionByName, parts)


def merge_cities(
    sources: Mapping[str, DataFrame], wanted: Sequence[str] = STOP_COLUMNS
) -> DataFrame:
    """One text table of all cities; the row number of each file is left out."""
    tagged = [tag_city(add_missing_columns(df, wanted), city) for city, df in sources.items()]
    return union_shared(tagged).drop(ROW_NUMBER)


def with_columns_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with just these columns; those it lacks are null."""
    return add_missing_columns(df, columns).select(*[F.col(f"`{name}`") for name in columns])
