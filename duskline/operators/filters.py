"""Row filters; each is a plain predicate that reaches the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from duskline.fixed import EXAMPLE_WINDOW


@dataclass(frozen=True)
class Period:
    """Days from ``start`` to ``end``, both included."""

    start: date
    end: date

    @classmethod
    def of_year(cls, year: int) -> Period:
        return cls(date(year, 1, 1), date(year, 12, 31))

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def in_period(stops: DataFrame, period: Period) -> DataFrame:
    """Both ends are kept. A ``year`` partition column, if any, is pruned too."""
    kept = stops.where(F.col("date").between(F.lit(period.start), F.lit(period.end)))
    if "year" in stops.columns:
        kept = kept.where(F.col("year").between(period.start.year, period.end.year))
    return kept


def without_cities(stops: DataFrame, cities: Sequence[str]) -> DataFrame:
    return stops.where(~F.col("city").isin(*cities))


def in_cities(stops: DataFrame, cities: Sequence[str]) -> DataFrame:
    return stops.where(F.col("city").isin(*cities))


def with_races(stops: DataFrame, races: Sequence[str]) -> DataFrame:
    return stops.where(F.col("subject_race").isin(*races))


def without_races(stops: DataFrame, races: Sequence[str]) -> DataFrame:
    return stops.where(~F.col("subject_race").isin(*races))


def with_sexes(stops: DataFrame, sexes: Sequence[str]) -> DataFrame:
    return stops.where(F.col("subject_sex").isin(*sexes))


def of_type(stops: DataFrame, stop_type: str = "vehicular") -> DataFrame:
    return stops.where(F.col("type") == stop_type)


def known_age(stops: DataFrame) -> DataFrame:
    """Age above 0; an age of 0 counts as unknown."""
    return stops.where(F.col("subject_age") > 0)


def known_hour(stops: DataFrame) -> DataFrame:
    """Hour known, whether unknown ones are null or labelled -1."""
    return stops.where(F.col("hour") >= 0)


def clock_window(window: tuple[int, int] = EXAMPLE_WINDOW) -> Column:
    """Strictly between two seconds of the day."""
    start, end = window
    return (F.col("second_of_day") > start) & (F.col("second_of_day") < end)


def in_clock_window(stops: DataFrame, window: tuple[int, int] = EXAMPLE_WINDOW) -> DataFrame:
    return stops.where(clock_window(window))
