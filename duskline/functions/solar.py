"""Sunset and dusk from the published low-precision solar position equations."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

RADIAN = pi / 180

# Altitude of the sun's centre in degrees at each event.
SUNSET_ALTITUDE = -0.833
DUSK_ALTITUDE = -6.0

# Constants of the solar position equations, degrees and days.
TRANSIT_OFFSET = 0.0009
MEAN_ANOMALY = (357.5291, 0.98560028)
CENTRE = (1.9148, 0.02, 0.0003)
PERIHELION = 102.9372
OBLIQUITY = 23.4397
TRANSIT_TERMS = (0.0053, -0.0069)
JULIAN_2000 = 2451545
JULIAN_1970 = 2440587.5


def with_sun_position(df: DataFrame) -> DataFrame:
    """Add the sun's position at the noon nearest to ``date`` at (``lat``, ``lon``).

    Each step is a projection of its own, so that Catalyst does not copy the
    trigonometry into every later use.
    """
    west = -F.col("lon") * RADIAN
    day = F.datediff(F.col("date"), F.lit("2000-01-01").cast("date"))
    m, sun = F.col("anomaly"), F.col("longitude")
    centre = RADIAN * (
        CENTRE[0] * F.sin(m) + CENTRE[1] * F.sin(2 * m) + CENTRE[2] * F.sin(3 * m)
    )
    return (
        df.withColumns({"west": west, "phi": F.col("lat") * RADIAN})
        .withColumn("cycle", F.round(day - TRANSIT_OFFSET - F.col("west") / (2 * pi)))
        .withColumn("transit", TRANSIT_OFFSET + F.col("west") / (2 * pi) + F.col("cycle"))
        .withColumn(
            "anomaly", RADIAN * (MEAN_ANOMALY[0] + MEAN_ANOMALY[1] * F.col("transit"))
        )
        .withColumn("longitude", m + centre + RADIAN * PERIHELION + pi)
        .withColumn("declination", F.asin(F.sin(F.lit(RADIAN * OBLIQUITY)) * F.sin(sun)))
    )


POSITION_COLUMNS = ("west", "phi", "cycle", "transit", "anomaly", "longitude", "declination")


def setting_second(altitude: float) -> Column:
    """UTC second, since 1970, at which the sun sinks to ``altitude`` degrees.

    Null where the sun does not cross that altitude on the day.
    """
    phi, dec = F.col("phi"), F.col("declination")
    cosine = (F.sin(F.lit(altitude * RADIAN)) - F.sin(phi) * F.sin(dec)) / (
        F.cos(phi) * F.cos(dec)
    )
    angle = F.when(cosine.between(-1, 1), F.acos(cosine))
    julian = (
        JULIAN_2000
        + TRANSIT_OFFSET
        + (angle + F.col("west")) / (2 * pi)
        + F.col("cycle")
        + TRANSIT_TERMS[0] * F.sin(F.col("anomaly"))
        + TRANSIT_TERMS[1] * F.sin(2 * F.col("longitude"))
    )
    return F.floor((julian - JULIAN_1970) * 86400)


def local_stamp(second: Column, zone: Column) -> Column:
    """Local wall clock of a UTC second; does not depend on the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), zone, epoch + F.make_dt_interval(secs=second))
