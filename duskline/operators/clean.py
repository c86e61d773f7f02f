"""Typing stops, dropping incomplete ones, labelling unknown values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duskline.fixed import (
    KEY_COLUMNS,
    LABELLED_NUMBER_COLUMNS,
    LABELLED_TEXT_COLUMNS,
    UNKNOWN_NUMBER,
    UNKNOWN_TEXT,
)
from duskline.functions import clock
from duskline.operators.harmonize import non_null_counts
from duskline.sources.readers import MALFORMED, SOURCE_FILE


def typed_columns(strict: bool = True) -> dict[str, Column]:
    """The typed columns of a stop, by name, and what they are read from."""
    return {
        "date": clock.stop_date(F.col("date"), strict),
        "second_of_day": clock.second_of_day(F.col("time"), strict),
        "lat": clock.number(F.col("lat"), strict),
        "lng": clock.number(F.col("lng"), strict),
        "subject_age": clock.number(F.col("subject_age"), strict),
    }


def typed_stops(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Dates, numbers and the second of the day from a merged text table.

    A date, time or number that cannot be read stops the job, so no row is lost unseen;
    with ``strict=False`` it becomes null. ``checked_stops`` keeps such rows apart.
    """
    return raw.withColumns(typed_columns(strict))


def checked_stops(raw: DataFrame) -> DataFrame:
    """``typed_stops`` of a merged table that was read with ``strict=False``, with what is wrong.

    ``reasons`` lists the columns that cannot be read, or ``fields`` for a row with more or fewer
    fields than its header; it is empty in good rows. ``row_text`` is null in good rows; else it is the text of
    a row with other fields, or the row's columns as CSV. Nothing is left out, and the rows are read once.
    """
    typed = typed_columns(strict=False)
    whole = F.col(MALFORMED).isNull()
    unread = [
        F.when(whole & F.col(source).isNotNull() & value.isNull(), F.lit(source))
        for source, value in zip(("date", "time", "lat", "lng", "subject_age"), typed.values())
    ]
    reasons = F.array_compact(F.array(F.when(~whole, F.lit("fields")), *unread))
    texts = [name for name in raw.columns if name not in (MALFORMED, SOURCE_FILE, "city")]
    shown = F.coalesce(F.col(MALFORMED), F.to_csv(F.struct(*[F.col(f"`{name}`") for name in texts])))
    told = raw.withColumn("reasons", reasons)
    bad = F.size("reasons") > 0
    return told.withColumns({**typed, "row_text": F.when(bad, shown)}).drop(MALFORMED)


def good_stops(checked: DataFrame) -> DataFrame:
    """The rows of ``checked_stops`` that can be read, as ``typed_stops`` gives them."""
    return checked.where(F.size("reasons") == 0).drop("reasons", "row_text", SOURCE_FILE)


def rejected_rows(checked: DataFrame) -> DataFrame:
    """The other rows: their city, file, text and what is wrong with them."""
    bad = checked.where(F.size("reasons") > 0)
    return bad.select("city", F.col(SOURCE_FILE).alias("file"), "row_text", "reasons")


def drop_incomplete(stops: DataFrame) -> DataFrame:
    """Only stops with a date, race, type and city; other gaps are allowed."""
    return stops.where(" AND ".join(f"{name} IS NOT NULL" for name in KEY_COLUMNS))


def with_clock_fields(stops: DataFrame) -> DataFrame:
    """Add ``hour`` (null when unknown) and ``weekday`` (0 is Monday)."""
    return stops.withColumns(
        {"hour": clock.hour_of(F.col("second_of_day")), "weekday": clock.weekday(F.col("date"))}
    )


def label_unknown(stops: DataFrame) -> DataFrame:
    """Report form: unknown texts as ``N/A``, unknown numbers as -1."""
    texts = {
        name: F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN_TEXT))
        for name in LABELLED_TEXT_COLUMNS
        if name in stops.columns
    }
    numbers = {
        name: F.coalesce(F.col(name), F.lit(UNKNOWN_NUMBER))
        for name in LABELLED_NUMBER_COLUMNS
        if name in stops.columns
    }
    return stops.withColumns(texts | numbers)


def completeness(df: DataFrame) -> DataFrame:
    """Non-null values per column."""
    return non_null_counts(df)


def column_report(df: DataFrame) -> DataFrame:
    """Rows ``(column_name, data_type, non_null)`` from one pass."""
    counted = df.agg(*[F.count(f"`{name}`").alias(name) for name in df.columns])
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col(f"`{name}`").alias("non_null"),
        )
        for name, kind in df.dtypes
    ]
    return counted.select(F.inline(F.array(*rows)))


def schema_report(df: DataFrame) -> DataFrame:
    """Rows ``(column_name, data_type)``; reads the schema only."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")


def first_rows(df: DataFrame, *order: str, rows: int = 5) -> DataFrame:
    """A look at the first rows in a stated order."""
    return df.orderBy(*order).limit(rows)
