"""Stops in the part of the evening that is light on some days and dark on others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duskline.functions import clock
from duskline.operators import filters
from duskline.operators.profile import count_where, row_count
from duskline.operators.sunset import with_dusk_bounds


def with_light(stops: DataFrame, solar_days: DataFrame) -> DataFrame:
    """Stops, or cells of them, with sunset, dusk, minute of the day and both flags.

    Catalyst and AQE pick the join from the size of the solar table, and AQE splits a
    hot day where both sides are shuffled.
    """
    joined = stops.join(with_dusk_bounds(solar_days), ["city", "date"], "left")
    minute = clock.minute_of(F.col("second_of_day"))
    return joined.withColumn("minute", minute).withColumns(
        {
            "minutes_after_dark": F.col("minute") - F.col("dusk_minute"),
            "is_dark": F.col("minute") > F.col("dusk_minute"),
            "is_black": F.col("subject_race") == "black",
        }
    )


def between_twilights() -> Column:
    """Within the city's earliest and latest dusk, both ends kept."""
    return F.col("minute").between(F.col("min_dusk_minute"), F.col("max_dusk_minute"))


def not_ambiguous() -> Column:
    """Not strictly between sunset and dusk; the minute of dusk itself stays."""
    return ~(
        (F.col("minute") > F.col("sunset_minute")) & (F.col("minute") < F.col("dusk_minute"))
    )


def twilight_stops(
    stops: DataFrame,
    solar_days: DataFrame,
    races: Sequence[str] = ("black", "white"),
) -> DataFrame:
    """Stops of the two races in the evening span, dark or light beyond doubt."""
    lit = with_light(stops, solar_days)
    return filters.with_races(lit.where(between_twilights() & not_ambiguous()), races)


def evening_cells(stops: DataFrame) -> DataFrame:
    """Stops per city, day, minute, race and whether in the clock window, in one pass.

    At most cities x days x 1440 x races x 2 rows, however many stops there are. The
    days that occur follow from the cells, so the stops are read once.
    """
    second = (clock.minute_of(F.col("second_of_day")) * 60).alias("second_of_day")
    window = F.coalesce(filters.clock_window(), F.lit(False)).alias("in_window")
    return stops.groupBy("city", "date", second, "subject_race", window).agg(
        F.count(F.lit(1)).alias("n")
    )


def twilight_stages(races: Sequence[str] = ("black", "white")) -> dict[str, Column]:
    """The filters between the vehicular stops and the stops of the twilight test."""
    return {
        "vehicular": F.lit(True),
        "between twilights": between_twilights(),
        "not ambiguous": not_ambiguous(),
        "two races": F.col("subject_race").isin(*races),
    }


def dark_share(twilight: DataFrame, *groups: str, weight: str | None = None) -> DataFrame:
    """Share of Black drivers in the dark and in the light, by ``groups``."""
    n, black = row_count(weight), count_where(F.col("is_black"), weight)
    return twilight.groupBy(*groups, "is_dark").agg((black / n).alias("prop_black"), n.alias("n"))


def dark_share_with_total(twilight: DataFrame, weight: str | None = None) -> DataFrame:
    """The share by city and over all cities (``city`` null) from one pass."""
    cells = twilight.groupBy("city", "is_dark").agg(
        count_where(F.col("is_black"), weight).alias("black"), row_count(weight).alias("n")
    )
    both = cells.groupingSets([["city", "is_dark"], ["is_dark"]], "city", "is_dark").agg(
        (F.sum("black") / F.sum("n")).alias("prop_black"), F.sum("n").alias("n")
    )
    return both


def model_cells(twilight: DataFrame, weight: str | None = None) -> DataFrame:
    """Stops per city, minute, light and race: at most cities x 1440 x 4 rows."""
    return twilight.groupBy("city", "minute", "is_dark", "is_black").agg(
        row_count(weight).alias("n")
    )
