"""Logistic regression of driver race on darkness, clock time and city."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import log
from operator import or_

import numpy as np
from pyspark.errors import UnsupportedOperationException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from duskline.functions.spline import spline_columns
from duskline.sources.lineage import cut_lineage

MAX_ITERATIONS = 50

# A term whose part of its own is smaller than this is taken for a combination.
DEPENDENT = 1e-10

COEFFICIENT_SCHEMA = "term string, estimate double, std_error double, z double, p double, status string"
FIT_SCHEMA = (
    "n_rows long, n_light long, n_dark long, spline_df int, deviance double, df_residual long, "
    "null_deviance double, df_null long, aic double, iterations int, converged boolean"
)


@dataclass(frozen=True)
class DarkData:
    """Count cells out of a checkpoint, and what the fit has to know about them."""

    cells: DataFrame
    low: float
    high: float
    knots: tuple[float, ...]
    cities: tuple[str, ...]
    light: int
    dark: int
    black: int


@dataclass(frozen=True)
class DarkModel:
    """``coefficients`` has one row per term, ``fit`` one row.

    ``parted`` holds the cells whose drivers a separated term tells apart: by city (None
    where all cities count as one) and light, whether they are all Black.
    """

    coefficients: DataFrame
    fit: DataFrame
    parted: Mapping[tuple[str | None, bool], bool] = field(default_factory=dict)


def spline_knots(cells: DataFrame, df: int = 6) -> DataFrame:
    """One row: ends and inner knots of the minute, with the cell counts as weights."""
    return cells.agg(*_knot_columns(df))


def _knot_columns(df: int) -> list[Column]:
    at = F.array(*[F.lit(i / df) for i in range(1, df)])
    return [
        F.min("minute").cast("double").alias("low"),
        F.max("minute").cast("double").alias("high"),
        F.percentile("minute", at, F.col("n")).alias("knots"),
    ]


def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def dark_data(cells: DataFrame, df: int = 6) -> DarkData:
    """Cut the lineage of the cells, so that no fitting step goes back to the stops.

    One small row comes to the driver: the knots, the row counts and the cities
    present, at most as many as the city table has.
    """
    kept = cut_lineage(cells.select("city", "minute", "is_dark", "is_black", "n"))
    facts = kept.agg(
        *_knot_columns(df),
        F.sort_array(F.collect_set("city")).alias("cities"),
        _rows_where(~F.col("is_dark")).alias("light"),
        _rows_where(F.col("is_dark")).alias("dark"),
        _rows_where(F.col("is_black")).alias("black"),
    ).first()
    low, high = facts["low"] or 0.0, facts["high"] or 0.0
    inner = sorted({knot for knot in facts["knots"] or [] if low < knot < high})
    return DarkData(
        kept,
        low,
        high,
        tuple(inner),
        tuple(facts["cities"]),
        facts["light"],
        facts["dark"],
        facts["black"],
    )


def light_cells(data: DarkData, by_city: bool) -> dict[tuple[str | None, bool], tuple[int, int]]:
    """Black and other drivers by city and light: two rows per city come to the driver."""
    city = F.col("city") if by_city else F.lit(None).cast("string")
    counts = data.cells.groupBy(city.alias("city"), "is_dark").agg(
        _rows_where(F.col("is_black")).alias("black"), _rows_where(~F.col("is_black")).alias("other")
    )
    return {(row["city"], row["is_dark"]): (row["black"], row["other"]) for row in counts.collect()}


def parted_cells(
    counts: Mapping[tuple[str | None, bool], tuple[int, int]]
) -> tuple[dict[tuple[str | None, bool], bool], set[str | None], bool]:
    """What a combination of the light and the cities tells apart without a doubt.

    Such a term has no finite estimate. Given: the parted cells and whether they are all Black, the
    cities without any other cells, and whether darkness is separated. A combination changes the log-odds
    of a city by any amount and those of the dark by one or minus one, or by nothing;
    no cell of Black drivers may go down, none of others up, none of both may move at
    all, and a cell that moves is parted. The parted cells say nothing about the other
    terms, so the search goes on without them. Terms of the minute are not looked at.
    """
    left = {key: 0 if all(n) else 1 if n[0] else -1 for key, n in counts.items() if any(n)}
    parted: dict[tuple[str | None, bool], bool] = {}
    dark = False

    def part(keys) -> None:
        for key in keys:
            parted[key] = left.pop(key) > 0

    while True:
        for city in {city for city, _ in left}:
            own = [key for key in left if key[0] == city]
            if abs(sum(left[key] for key in own)) == len(own):
                part(own)
        known = {city for city, _ in left}
        moved = {step: [_moved(left, city, step) for city in known] for step in (1, -1)}
        for step, by_city in moved.items():
            keys = [key for one in by_city if one for key in one]
            if not dark and keys and None not in by_city:
                dark = True
                part(keys)
                break
        else:
            return parted, {city for city, _ in parted} - {city for city, _ in left}, dark


def _moved(
    left: Mapping[tuple[str | None, bool], int], city: str | None, step: int
) -> list[tuple[str | None, bool]] | None:
    """The cells of a city that move if the dark gains ``step`` on the light; None if it can't."""
    light, dark = left.get((city, False)), left.get((city, True))
    if light == 0 or dark == 0:
        if light == dark:
            return None
        # The cell of both stays, so all of the step falls to the other cell, if there is one.
        other, way = ((city, True), step) if light == 0 else ((city, False), -step)
        side = left.get(other)
        return [] if side is None else [other] if side == way else None
    return [(city, False), (city, True)] if dark == step else None


def design_columns(data: DarkData, by_city: bool = False, base: str | None = None) -> dict[str, Column]:
    """Model terms: darkness, the spline of the minute, and the cities but ``base``, else the first."""
    terms = {"is_dark": F.col("is_dark").cast("double")}
    if data.high > data.low:
        spline = spline_columns(F.col("minute"), data.knots, data.low, data.high)
        terms |= {f"minute_{i}": column for i, column in enumerate(spline, start=1)}
    if by_city:
        first = data.cities[0] if base is None and data.cities else base
        terms |= {
            f"city_{city}": (F.col("city") == city).cast("double") for city in data.cities if city != first
        }
    return terms


def _is_parted(parted: Mapping[tuple[str | None, bool], bool]) -> Column:
    """Whether a cell is one of ``parted``; a cell counts for all cities where the city is None."""
    return _any(
        (F.lit(True) if city is None else F.col("city") == city) & (F.col("is_dark") == dark)
        for city, dark in parted
    )


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def fit_dark_model(data: DarkData, by_city: bool = False) -> DarkModel:
    """Binomial regression on the count cells.

    The cells stand for their rows: estimates, errors and deviance are those of a
    fit on single stops. Repeated knots lower the degrees of freedom of the
    spline, which ``fit`` reports.

    ``status`` tells what became of a term. ``separated``: it tells the races apart
    without a doubt, as a city or light whose drivers are all of one race, so it has no finite
    estimate and its numbers are null. The others have the values they tend to as
    it grows: those of a fit without it and the cells it parts. It still counts as a parameter. The base is the
    first city that is not separated. ``dependent``: the term is a combination of the terms
    before it and is left out. ``no rows``: nothing is left to fit it on. ``converged`` is false
    where the steps ran out, as they may for a span of minutes with one race only.
    """
    spark = data.cells.sparkSession
    rows = data.light + data.dark
    one_race = data.black in (0, rows)
    counts = {} if one_race else light_cells(data, by_city)
    parted, gone, dark = parted_cells(counts)
    base = next((city for city in data.cities if city not in gone), None) if gone else None
    terms = design_columns(data, by_city, base)
    names = ["intercept", *terms]
    separated = {f"city_{city}" for city in gone} | ({"is_dark"} if dark else set())
    separated &= set(names)
    spline_df = sum(name.startswith("minute_") for name in names)
    known = (rows, data.light, data.dark, spline_df)

    def model(used: Mapping[str, tuple], status: str, numbers: tuple) -> DarkModel:
        told = {name: "separated" for name in separated} | {name: "fitted" for name in used}
        table = [(name, *used.get(name, [None] * 4), told.get(name, status)) for name in names]
        return DarkModel(
            spark.createDataFrame(table, COEFFICIENT_SCHEMA),
            spark.createDataFrame([(*known, *numbers)], FIT_SCHEMA),
            parted,
        )

    if one_race:
        return model({}, "separated" if rows else "no rows", (None,) * 7)
    if len(parted) == sum(map(any, counts.values())):
        return model({}, "no rows", (None,) * 7)
    columns = [column.alias(f"x{i}") for i, column in enumerate(terms.values())]
    design = data.cells.where(~_is_parted(parted)).select(
        F.col("is_black").cast("double").alias("label"),
        F.col("n").cast("double").alias("n"),
        *columns,
    )
    kept = [i for i, name in enumerate(terms) if name not in separated]
    fitted = _fit(design, kept) if kept else None
    if fitted is None:
        kept = _independent_terms(design, kept)
        fitted = _fit(design, kept) if kept else None
    if fitted is None:
        return model({}, "no rows", (None,) * 7)

    numbers, deviance, iterations = fitted
    used = dict(zip(["intercept", *(names[i + 1] for i in kept)], numbers))
    count = len(used) + len(separated)
    share = data.black / rows
    null_deviance = -2 * (data.black * log(share) + (rows - data.black) * log(1 - share))
    fit = (
        deviance,
        rows - count,
        null_deviance,
        rows - 1,
        deviance + 2.0 * count,
        iterations,
        iterations < MAX_ITERATIONS,
    )
    return model(used, "dependent", fit)


def _features(design: DataFrame, terms: Sequence[int]) -> DataFrame:
    return VectorAssembler(inputCols=[f"x{i}" for i in terms], outputCol="features").transform(
        design
    )


def _fit(
    design: DataFrame, terms: Sequence[int]
) -> tuple[list[tuple[float, ...]], float, int] | None:
    """Estimate, error, z and p per term, the intercept first, the deviance and the steps.

    None where the terms depend on each other, as there are no errors then.
    """
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", weightCol="n", maxIter=MAX_ITERATIONS, tol=1e-12, regParam=0.0
    ).fit(_features(design, terms))
    summary = model.summary
    try:
        errors = summary.coefficientStandardErrors
    except UnsupportedOperationException:
        return None
    # Spark puts the intercept last in all but the coefficients.
    estimates = [*model.coefficients.toArray().tolist(), model.intercept]
    table = [
        tuple(map(float, row)) for row in zip(estimates, errors, summary.tValues, summary.pValues)
    ]
    return [table[-1], *table[:-1]], float(summary.deviance), int(summary.numIterations)


def _independent_terms(design: DataFrame, terms: Sequence[int]) -> list[int]:
    """Those of the terms that are no combination of the intercept and the terms before them.

    Decided on their correlation matrix, one small aggregate of the cells.
    """
    if not terms:
        return []
    correlation = Correlation.corr(_features(design, terms), "features").first()[0].toArray()
    constant = np.isnan(correlation).sum(axis=1) >= len(terms) - 1
    kept: list[int] = []
    for place in np.flatnonzero(~constant) if len(terms) > 1 else [0]:
        known = correlation[np.ix_(kept, kept)]
        shared = correlation[kept, place]
        if not kept or 1 - shared @ np.linalg.solve(known, shared) > DEPENDENT:
            kept.append(int(place))
    return [terms[place] for place in kept]


def dark_estimate(model: DarkModel) -> DataFrame:
    """Estimate and standard error of the effect of darkness."""
    return model.coefficients.where(F.col("term") == "is_dark").select("estimate", "std_error")


def fitted_cells(data: DarkData, model: DarkModel) -> DataFrame:
    """The cells with ``fitted``, the share of Black drivers the model gives them.

    The driver reads the coefficients, one row per term. A parted cell has 0 or 1.
    """
    table = {row["term"]: row["estimate"] for row in model.coefficients.collect()}
    named = [name for name in table if name.startswith("city_")]
    base = next((city for city in data.cities if f"city_{city}" not in named), None)
    terms = design_columns(data, by_city=bool(named), base=base)
    parts = [
        F.lit(float(table[name])) * column
        for name, column in terms.items()
        if table.get(name) is not None
    ]
    line = sum(parts, F.lit(table["intercept"]).cast("double"))
    share = F.when(_is_parted({k: v for k, v in model.parted.items() if v}), 1.0)
    share = share.when(_is_parted({k: v for k, v in model.parted.items() if not v}), 0.0)
    return data.cells.withColumn("fitted", share.otherwise(1 / (1 + F.exp(-line))))
