"""Counts, shares and date spans.

Every operator takes rows, or count cells with the name of their count column in
``weight``. So one pass can make cells and all tables can follow from them.
Groups are aggregated before they are shuffled; what follows a shuffle has one
row per group and not per stop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.fixed import PROFILE_RACES, SEXES, UNKNOWN_TEXT, UNLISTED_RACES
from duskline.operators import filters


def row_count(weight: str | None = None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def count_where(condition: Column, weight: str | None = None) -> Column:
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def frequency(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Rows per value, nulls left out, most frequent first."""
    return by_frequency(_frequency(df, column, weight), column)


def frequency_by_key(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Rows per value in the order of the values."""
    return _frequency(df, column, weight).orderBy(column)


def by_frequency(counts: DataFrame, column: str) -> DataFrame:
    return counts.orderBy(F.desc("n"), column)


def relative_frequency(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Share of each value among the rows that have one.

    The total is a scalar subquery over the counts: both share one shuffle, and
    no value list is moved to a single task.
    """
    counts = _frequency(df, column, weight)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def relative_sex_frequency(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Share of each sex with unknown as a value of its own."""
    labelled = df.withColumn(
        "subject_sex", F.coalesce("subject_sex", F.lit(UNKNOWN_TEXT))
    )
    return relative_frequency(labelled, "subject_sex", weight)


def _frequency(df: DataFrame, column: str, weight: str | None) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(row_count(weight).alias("n"))


def share_by_city(
    df: DataFrame, column: str, names: Mapping[str, str], weight: str | None = None
) -> DataFrame:
    """Share of each named value among a city's rows; 0.0 where it is absent."""
    total = row_count(weight)
    return df.groupBy("city").agg(
        *[
            (count_where(F.col(column) == value, weight) / total).alias(name)
            for value, name in names.items()
        ]
    )


def race_share_by_city(
    df: DataFrame, races: Mapping[str, str] = PROFILE_RACES, weight: str | None = None
) -> DataFrame:
    listed = filters.without_races(df, UNLISTED_RACES)
    return share_by_city(listed, "subject_race", races, weight)


def sex_share_by_city(
    df: DataFrame, sexes: Mapping[str, str] = SEXES, weight: str | None = None
) -> DataFrame:
    return share_by_city(filters.with_sexes(df, list(sexes)), "subject_sex", sexes, weight)


def percent_by_city(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Percentage of a city's rows per value; values without rows are absent."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy("city", column)
        .agg(row_count(weight).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("city"))
    return counts.select("city", column, (F.col("n") / total * 100).alias("pct"))


def hour_percent(df: DataFrame, weight: str | None = None) -> DataFrame:
    return percent_by_city(filters.known_hour(df), "hour", weight).orderBy("city", "hour")


def weekday_percent(df: DataFrame, weight: str | None = None) -> DataFrame:
    return percent_by_city(df, "weekday", weight).orderBy("city", "weekday")


def date_span(df: DataFrame) -> DataFrame:
    """First and last date per city, and over all cities (``city`` null).

    The overall row is made from the city rows, so the stops are not expanded.
    """
    cities = df.groupBy("city").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    return cities.rollup("city").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    )


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def stage_counts(
    df: DataFrame, stages: Mapping[str, Column], weight: str | None = None
) -> DataFrame:
    """Rows left after each of a chain of filters, in one pass.

    Each stage keeps what the stages before it kept; ``step`` numbers them.
    """
    counts = _passed(df, stages).groupBy("passed").agg(row_count(weight).alias("n"))
    return _per_stage(counts, stages, {"rows": F.col("n")})


def stage_completeness(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Non-null values per column after each of a chain of filters, in one pass."""
    names = df.columns
    counts = (
        _passed(df, stages).groupBy("passed").agg(*[F.count(name).alias(name) for name in names])
    )
    wide = _per_stage(counts, stages, {name: F.col(name) for name in names})
    return wide.unpivot(["step", "stage"], names, "column_name", "non_null")


def stage_cells(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows and values per city, day and stage reached, from one pass over the stops.

    ``cell_counts``, ``cell_completeness`` and ``date_span`` follow from it.
    """
    others = [name for name in df.columns if name not in ("city", "date")]
    return (
        _passed(df, stages)
        .groupBy("city", "date", "passed")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count(name).alias(name) for name in others])
    )


def cell_counts(cells: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """``stage_counts`` from ``stage_cells``."""
    counts = cells.groupBy("passed").agg(F.sum("n").alias("n"))
    return _per_stage(counts, stages, {"rows": F.col("n")})


def cell_completeness(cells: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """``stage_completeness`` from ``stage_cells``."""
    names = [name for name in cells.columns if name not in ("passed", "n")]
    known = {
        name: F.sum(F.when(F.col(name).isNotNull(), F.col("n")).otherwise(0))
        if name in ("city", "date")
        else F.sum(name)
        for name in names
    }
    counts = cells.groupBy("passed").agg(*[value.alias(name) for name, value in known.items()])
    wide = _per_stage(counts, stages, {name: F.col(name) for name in names})
    return wide.unpivot(["step", "stage"], names, "column_name", "non_null")


def _passed(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """How many of the stages, in their order, a row passes."""
    passed = F.lit(len(stages))
    for step, condition in reversed(list(enumerate(stages.values()))):
        passed = F.when(condition, passed).otherwise(step)
    return df.withColumn("passed", passed)


def _per_stage(
    counts: DataFrame, stages: Mapping[str, Column], numbers: Mapping[str, Column]
) -> DataFrame:
    """Sums over the rows that passed each stage; ``counts`` has one row per stage at most."""
    sums = [
        F.struct(
            F.lit(step).alias("step"),
            F.lit(stage).alias("stage"),
            *[
                F.coalesce(F.sum(F.when(F.col("passed") > step, number)), F.lit(0)).alias(name)
                for name, number in numbers.items()
            ],
        )
        for step, stage in enumerate(stages)
    ]
    return counts.agg(F.array(*sums).alias("stages")).select(F.inline("stages"))


CELL_COLUMNS = ("city", "type", "subject_sex", "subject_race", "hour")


def profile_cells(df: DataFrame, columns: Sequence[str] = CELL_COLUMNS) -> DataFrame:
    """Count cells: a few thousand rows from which the share tables follow."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


DAY_COLUMNS = ("city", "date", "weekday")
AGE_COLUMNS = ("subject_age",)


def all_cells(df: DataFrame) -> DataFrame:
    """Profile, day and age cells from one pass; ``cells`` names the kind of a row."""
    sets = {"profile": CELL_COLUMNS, "day": DAY_COLUMNS, "age": AGE_COLUMNS}
    names = list(dict.fromkeys(name for columns in sets.values() for name in columns))
    # A column outside a row's set has grouping 1, a null inside it 0.
    kind = F.when(F.grouping("type") == 0, "profile").when(F.grouping("date") == 0, "day")
    return df.groupingSets([list(columns) for columns in sets.values()], *names).agg(
        F.count(F.lit(1)).alias("n"), kind.otherwise("age").alias("cells")
    )


def cells_of(cells: DataFrame, kind: str) -> DataFrame:
    columns = {"profile": CELL_COLUMNS, "day": DAY_COLUMNS, "age": AGE_COLUMNS}[kind]
    return cells.where(F.col("cells") == kind).select(*columns, "n")


def day_cells(df: DataFrame) -> DataFrame:
    """Stops per city and day; weekdays, spans and date histograms follow from it."""
    return df.groupBy(*DAY_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
