"""Stops per head and the interval of the difference between two groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duskline.fixed import INTERVAL_Z, RATE_RACES
from duskline.operators import filters
from duskline.operators.profile import row_count


def race_matrix(
    stops: DataFrame, races: Sequence[str] = RATE_RACES, weight: str | None = None
) -> DataFrame:
    """Stops per city and race; null, not 0, where a city has none of a race."""
    counts = filters.with_races(stops, races).groupBy("city").pivot("subject_race", list(races))
    return counts.agg(row_count(weight))


def population_share(pop: DataFrame, races: Sequence[str] = RATE_RACES) -> DataFrame:
    return pop.withColumns(
        {f"{race}_prop": F.try_divide(f"{race}_pop", "total_pop") for race in races}
    )


def per_capita(
    counts: DataFrame, pop: DataFrame, races: Sequence[str] = RATE_RACES
) -> DataFrame:
    """Counts with the population of their city and the stops per head.

    Both sides have one row per city and Catalyst picks the join.
    """
    return counts.join(pop, "city", "left").withColumns(
        {f"{race}_per_cap": F.try_divide(race, f"{race}_pop") for race in races}
    )


def per_capita_report(rates: DataFrame, races: Sequence[str] = RATE_RACES) -> DataFrame:
    return rates.select("city", *[f"{race}_per_cap" for race in races])


def rate_means(rates: DataFrame, races: Sequence[str] = RATE_RACES) -> DataFrame:
    """One row: unweighted mean rate and summed population per race.

    Null if any city lacks the number, as a mean over unknown values is unknown.
    """
    means = [_strict(F.avg, f"{race}_per_cap").alias(f"{race}_mean") for race in races]
    sums = [_strict(F.sum, f"{race}_pop").alias(f"{race}_pop_sum") for race in races]
    return rates.agg(*means, *sums)


def _strict(function, column: str) -> Column:
    return F.when(F.count_if(F.col(column).isNull()) == 0, function(column))


def rate_interval(
    means: DataFrame,
    base: str = "white",
    others: Sequence[str] = ("black", "hispanic"),
    z: float = INTERVAL_Z,
) -> DataFrame:
    """Interval of ``base`` minus other, one row per pair.

    Takes the unweighted mean rate as one proportion with the summed population
    as its sample size.
    """
    pairs = []
    for other in others:
        difference = F.col(f"{base}_mean") - F.col(f"{other}_mean")
        margin = z * F.sqrt(_variance(base) + _variance(other))
        pairs.append(
            F.struct(
                F.lit(base).alias("base"),
                F.lit(other).alias("other"),
                difference.alias("difference"),
                (difference - margin).alias("lower_bound"),
                (difference + margin).alias("upper_bound"),
            )
        )
    return means.select(F.inline(F.array(*pairs)))


def _variance(race: str) -> Column:
    mean = F.col(f"{race}_mean")
    return F.try_divide(mean * (1 - mean), F.col(f"{race}_pop_sum"))


def rate_ratio(
    means: DataFrame, base: str = "white", others: Sequence[str] = ("black", "hispanic")
) -> DataFrame:
    """How many times the base rate each other rate is."""
    pairs = [
        F.struct(
            F.lit(base).alias("base"),
            F.lit(other).alias("other"),
            F.try_divide(f"{other}_mean", f"{base}_mean").alias("ratio"),
        )
        for other in others
    ]
    return means.select(F.inline(F.array(*pairs)))
