"""Sunset and dusk per city and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from duskline.fixed import CITY_POINTS
from duskline.functions import clock, solar

CITY_SCHEMA = "city string, lat double, lon double, tz string"

Point = tuple[str, float, float, str]


def city_points(spark: SparkSession, points: Sequence[Point] = CITY_POINTS) -> DataFrame:
    """The city table, as long as the given list.

    A city may have one point only, as a second one would double its stops.
    """
    cities = [point[0] for point in points]
    if len(set(cities)) < len(cities):
        raise ValueError("a city has more than one point")
    return spark.createDataFrame(list(points), CITY_SCHEMA)


def solar_table(stops: DataFrame, points: Sequence[Point] = CITY_POINTS) -> DataFrame:
    """Local sunset and dusk for each city and date that has stops.

    Reads two columns of the stops and reduces them to distinct days before
    anything is shuffled. Cities without a point are left out.
    """
    days = stops.select("city", "date").where(F.col("date").isNotNull()).distinct()
    cities = city_points(stops.sparkSession, points)
    sun = solar.with_sun_position(days.join(cities, "city"))
    sunset = solar.local_stamp(solar.setting_second(solar.SUNSET_ALTITUDE), F.col("tz"))
    dusk = solar.local_stamp(solar.setting_second(solar.DUSK_ALTITUDE), F.col("tz"))
    stamped = sun.select("city", "date", sunset.alias("sunset_at"), dusk.alias("dusk_at"))
    timed = stamped.select(
        "city",
        "date",
        clock.clock_text(F.col("sunset_at")).alias("sunset"),
        clock.clock_text(F.col("dusk_at")).alias("dusk"),
        (F.hour("sunset_at") * 60 + F.minute("sunset_at")).alias("sunset_minute"),
        (F.hour("dusk_at") * 60 + F.minute("dusk_at")).alias("dusk_minute"),
    )
    minutes = [name for name in timed.columns if name.endswith("minute")]
    return timed.select("city", "date", "sunset", "dusk", *minutes)


def dusk_extremes(solar_days: DataFrame) -> DataFrame:
    """The days of earliest and latest dusk of each city, ties kept."""
    city = Window.partitionBy("city")
    return (
        solar_days.withColumns(
            {"earliest": F.min("dusk").over(city), "latest": F.max("dusk").over(city)}
        )
        .where((F.col("dusk") == F.col("earliest")) | (F.col("dusk") == F.col("latest")))
        .drop("earliest", "latest")
    )


def with_dusk_bounds(solar_days: DataFrame) -> DataFrame:
    """Earliest and latest dusk minute of the city on each of its days.

    Taken on the solar table, which has one row per city and day, and not on the
    stops: the values are the same and the stops need no shuffle.
    """
    city = Window.partitionBy("city")
    return solar_days.withColumns(
        {
            "min_dusk_minute": F.min("dusk_minute").over(city),
            "max_dusk_minute": F.max("dusk_minute").over(city),
        }
    )
