"""Parameters of one year's analysis."""

from __future__ import annotations

from dataclasses import dataclass

from duskline.fixed import CITY_POINTS, RATE_RACES
from duskline.operators.filters import Period


@dataclass(frozen=True)
class Study:
    period: Period
    without_cities: tuple[str, ...]
    twilight_cities: tuple[str, ...]
    races: tuple[str, ...] = RATE_RACES
    points: tuple[tuple[str, float, float, str], ...] = CITY_POINTS

    def __post_init__(self) -> None:
        known = {point[0] for point in self.points}
        if missing := [city for city in self.twilight_cities if city not in known]:
            raise ValueError(f"twilight cities without a point: {', '.join(missing)}")

    @property
    def twilight_points(self) -> list[tuple[str, float, float, str]]:
        return [point for point in self.points if point[0] in self.twilight_cities]


# The cities of each year's analysis.
STUDY_2014 = Study(
    period=Period.of_year(2014),
    without_cities=("Santa Ana",),
    twilight_cities=(
        "Bakersfield",
        "Los Angeles",
        "Oakland",
        "San Diego",
        "San Francisco",
        "San Jose",
    ),
)
STUDY_2017 = Study(
    period=Period.of_year(2017),
    without_cities=("San Diego", "Santa Ana"),
    twilight_cities=("Bakersfield", "Los Angeles", "Oakland", "San Jose"),
)
