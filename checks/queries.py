"""The registered queries: (session, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from checks import views
from duskline.fixed import INDEX_COLUMNS
from duskline.functions import spline
from duskline.functions.text import blank_to_null
from duskline.operators import (
    census,
    clean,
    filters,
    harmonize,
    histogram,
    model,
    profile,
    rates,
    sunset,
    twilight,
)
from duskline.plans.jobs import merge_stops, study_stages, study_stops
from duskline.plans.study import Study
from duskline.sources.lineage import cut_lineage, remove_folder, run_folder
from duskline.sources.readers import read_cities, read_table, read_text_table
from duskline.sources.writers import write_table

# Part of a year and one city less, for the profile queries.
PROFILE = Study(
    period=filters.Period(date(2014, 3, 1), date(2014, 9, 30)),
    without_cities=("ASIA",),
    twilight_cities=(),
    points=views.POINTS,
)
# The whole year and all cities, for rates and the twilight test.
YEAR = Study(
    period=filters.Period.of_year(2014),
    without_cities=("Santa Ana",),
    twilight_cities=views.CITIES,
    points=views.POINTS,
)
# The same with fewer cities.
FEWER = Study(
    period=filters.Period.of_year(2014),
    without_cities=("EUROPE", "Santa Ana"),
    twilight_cities=("AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"),
    points=views.POINTS,
)

MODEL_KEYS = ("city", "minute", "is_dark", "is_black")


def _profile_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_stops(views.stops(spark, sf_dir), PROFILE)


def _rounded(df: DataFrame) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, 6) for name in doubles})


def _year_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_stops(views.stops(spark, sf_dir), YEAR)


def _on_year(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: _rounded(build(_year_stops(spark, sf_dir)))


def _on_all(build: Callable[[DataFrame], DataFrame]):
    """On unfiltered stops, as a look that comes before a period is chosen."""
    return lambda spark, sf_dir: _rounded(build(views.stops(spark, sf_dir)))


def _ranked(df: DataFrame) -> DataFrame:
    """The place of each row in the order an operator gave; for short results."""
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    return df.withColumn("rank", place)


def column_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harmonize.filled_inventory(views.sources(spark, sf_dir))
    return found.withColumn("sources", F.array_join("sources", ","))


def harmonized_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonize.merge_cities(views.sources(spark, sf_dir))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files per city written, scanned and merged: values found per city."""
    folder = run_folder(spark, "files")
    write_table(views.raw_stops(spark, sf_dir), f"{folder}/csv", ["city"], "csv")
    found = read_cities(spark, {city: f"{folder}/csv/city={city}" for city in views.CITIES})
    merged = clean.typed_stops(harmonize.merge_cities(found))
    write_table(merged.withColumn("year", F.year("date")), f"{folder}/merged", ["city", "year"])
    back = filters.in_period(read_table(spark, f"{folder}/merged"), PROFILE.period)
    return _kept_rows(
        back.groupBy("city").agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(c).alias(c) for c in back.columns if c not in ("city", "year")],
        ),
        folder,
    )


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with planted faults and quoted line breaks merged: rows per city and fault, and the good ones."""
    folder = run_folder(spark, "planted")
    paths = views.write_planted_files(spark, sf_dir, f"{folder}/csv")
    out, rejects = f"{folder}/merged", f"{folder}/rejects"
    merge_stops(spark, paths, out, multi_line=True, rejects=rejects, most_rejected=0.05)
    found = F.when(F.contains("outcome", F.lit("\n")), "good, with a line break").otherwise("good")
    good = read_table(spark, out).select("city", found.alias("found"))
    bad = read_table(spark, rejects).select("city", F.explode("reasons").alias("found"))
    return _kept_rows(good.union(bad).groupBy("city", "found").agg(F.count(F.lit(1)).alias("rows")), folder)


def replaced_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops per city and year after two cities are merged, and one again with fewer stops."""
    folder = run_folder(spark, "replaced")
    stops = views.raw_stops(spark, sf_dir).where(F.col("city").isin("ASIA", "MIDDLE EAST"))
    write_table(stops, f"{folder}/all", ["city"], "csv")
    write_table(stops.where("type = 'pedestrian' and date < '2014-07-01'"), f"{folder}/fewer", ["city"], "csv")
    for kind, cities in (("all", ("ASIA", "MIDDLE EAST")), ("fewer", ("ASIA",))):
        paths = {city: f"{folder}/{kind}/city={city}" for city in cities}
        merge_stops(spark, paths, f"{folder}/merged", rebalance=False)
    counts = read_table(spark, f"{folder}/merged").groupBy("city", "year")
    return _kept_rows(counts.agg(F.count(F.lit(1)).alias("rows")), folder)


def _kept_rows(df: DataFrame, folder: str) -> DataFrame:
    """A row per city or column, taken out of a folder of this run, which goes."""
    rows = df.collect()
    remove_folder(df.sparkSession, folder)
    return df.sparkSession.createDataFrame(rows, df.schema)


def census_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two wide census files written, scanned, joined on the fact and turned."""
    folder = run_folder(spark, "census")
    for number, part in enumerate(views.census_parts(spark, sf_dir)):
        write_table(part, f"{folder}/{number}", file_format="csv")
    parts = [read_text_table(spark, f"{folder}/{number}") for number in range(2)]
    return _kept_rows(_rounded(census.census_by_city(census.join_parts(*parts))), folder)


def indexed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per column of a file that was saved with a row index and is read without it."""
    folder = run_folder(spark, "indexed")
    counts = _year_stops(spark, sf_dir).groupBy("city").agg(F.count(F.lit(1)).alias("stops"))
    number = F.row_number().over(Window.orderBy("city")) - 1
    write_table(counts.select(number.alias(INDEX_COLUMNS[0]), "city", "stops"), folder, file_format="csv")
    return _kept_rows(clean.completeness(read_text_table(spark, folder)), folder)


def parsed_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stop read from its text: missing-value tokens, dates, numbers and times."""
    return clean.typed_stops(blank_to_null(views.raw_stops(spark, sf_dir)))


def column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.column_report(views.stops(spark, sf_dir).drop("raw_row_number"))


def clean_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_races(_profile_stops(spark, sf_dir), PROFILE.races)


def labelled_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.label_unknown(_profile_stops(spark, sf_dir)).drop("second_of_day")


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = _year_stops(spark, sf_dir).withColumn("row", F.col("raw_row_number").cast("long"))
    return clean.first_rows(stops.select("row", "city", "date", "subject_race"), "row")


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.stage_counts(views.stops(spark, sf_dir), study_stages(PROFILE))


def stage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = views.stops(spark, sf_dir).drop("raw_row_number")
    return profile.stage_completeness(stops, study_stages(PROFILE))


def profile_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours per city from count cells instead of stops."""
    cells = profile.profile_cells(_year_stops(spark, sf_dir))
    return _rounded(profile.hour_percent(cells, "n"))


def weekday_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.weekday_percent(profile.day_cells(_year_stops(spark, sf_dir)), "n"))


def _race_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.race_matrix(study_stops(views.stops(spark, sf_dir), YEAR))


def _census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.census_by_city(census.join_parts(*views.census_parts(spark, sf_dir)))


def census_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_census(spark, sf_dir))


def _per_capita_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates where the census lacks a city."""
    population = census.census_report(_census(spark, sf_dir))
    known = population.where(F.col("city") != "MIDDLE EAST")
    return rates.per_capita(_race_matrix(spark, sf_dir), known)


def per_capita_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_per_capita_gap(spark, sf_dir))


def rate_means_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.rate_means(_per_capita_gap(spark, sf_dir)))


def population_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.population_share(census.census_report(_census(spark, sf_dir))))


def _per_capita(spark: SparkSession, sf_dir: str) -> DataFrame:
    population = census.census_report(_census(spark, sf_dir))
    return rates.per_capita(_race_matrix(spark, sf_dir), population)


def per_capita(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_per_capita(spark, sf_dir))


def per_capita_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.per_capita_report(_per_capita(spark, sf_dir)))


def _rate_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.rate_means(_per_capita(spark, sf_dir))


def rate_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rate_means(spark, sf_dir))


def rate_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.rate_interval(_rate_means(spark, sf_dir)))


def rate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.rate_ratio(_rate_means(spark, sf_dir)))


def _evening(spark: SparkSession, sf_dir: str, study: Study) -> DataFrame:
    """Vehicular stops of the study's twilight cities."""
    stops = filters.with_races(study_stops(views.stops(spark, sf_dir), study), study.races)
    return filters.in_cities(filters.of_type(stops), study.twilight_cities)


def _lit_cells(spark: SparkSession, sf_dir: str, study: Study) -> DataFrame:
    """Evening cells with the light they were in.

    The days come from the same cells. These are cut off from the stops, as Catalyst would
    push different filters into both uses and read the stops twice.
    """
    cells = cut_lineage(twilight.evening_cells(_evening(spark, sf_dir, study)))
    return twilight.with_light(cells, sunset.solar_table(cells, study.twilight_points))


def _twilight(spark: SparkSession, sf_dir: str, study: Study = YEAR) -> DataFrame:
    """Cells of the twilight test, with their number of stops in ``n``."""
    kept = reduce(and_, twilight.twilight_stages().values())
    return _lit_cells(spark, sf_dir, study).where(kept)


def solar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sunset.solar_table(_evening(spark, sf_dir, YEAR), YEAR.twilight_points)


def dusk_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sunset.dusk_extremes(solar_table(spark, sf_dir))


def twilight_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rows themselves are asked for: the narrow evening stops are kept for both uses.
    stops = cut_lineage(_evening(spark, sf_dir, YEAR))
    days = sunset.solar_table(stops, YEAR.twilight_points)
    return twilight.twilight_stops(stops, days).select(
        "raw_row_number",
        "city",
        "date",
        "time",
        "subject_race",
        "sunset",
        "dusk",
        "sunset_minute",
        "dusk_minute",
        "min_dusk_minute",
        "max_dusk_minute",
        "minute",
        "minutes_after_dark",
        "is_dark",
        "is_black",
    )


def twilight_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = _lit_cells(spark, sf_dir, YEAR)
    return profile.stage_counts(lit, twilight.twilight_stages(), "n")


def twilight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequency_by_key(_twilight(spark, sf_dir, FEWER), "city", "n")


def dark_share_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(twilight.dark_share(_twilight(spark, sf_dir).where("in_window"), "city", weight="n"))


def dark_share_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(twilight.dark_share(_twilight(spark, sf_dir).where("in_window"), weight="n"))


def dark_share_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(twilight.dark_share_with_total(_twilight(spark, sf_dir), "n"))


def model_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twilight.model_cells(_twilight(spark, sf_dir), "n")


def spline_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = model.spline_knots(model_cells(spark, sf_dir))
    knots = [F.get("knots", F.lit(i)).alias(f"knot_{i + 1}") for i in range(5)]
    return _rounded(ends.select("low", "high", *knots))


def spline_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spline's columns the models are fitted on, at each minute that occurs."""
    data = model.dark_data(model_cells(spark, sf_dir))
    columns = spline.spline_columns(F.col("minute"), data.knots, data.low, data.high)
    named = [column.alias(f"minute_{i}") for i, column in enumerate(columns, start=1)]
    return _rounded(data.cells.select("minute", *named).distinct())


def model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = model.dark_data(model_cells(spark, sf_dir))
    return _rounded(model.fit_dark_model(data).coefficients)


def model_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = model.dark_data(model_cells(spark, sf_dir))
    return _rounded(model.fit_dark_model(data, by_city=True).coefficients)


def model_city_fewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = model.dark_data(twilight.model_cells(_twilight(spark, sf_dir, FEWER), "n"))
    return _rounded(model.fit_dark_model(data, by_city=True).coefficients)


def model_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by city where a city, the base, or light and cities together tell the races apart."""
    cells = cut_lineage(model_cells(spark, sf_dir))
    black, europe = F.col("is_black"), F.col("city") == "EUROPE"
    races = {
        "city": black | europe,
        "base": black | (F.col("city") == "AFRICA"),
        # Neither the dark nor any city has drivers of one race only.
        "light": F.when(europe == F.col("is_dark"), europe).otherwise(black),
    }
    parts = []
    for found, black in races.items():
        data = model.dark_data(cells.withColumn("is_black", black).groupBy(*MODEL_KEYS).agg(F.sum("n").alias("n")))
        fitted = model.fit_dark_model(data, by_city=True)
        parts.append(fitted.coefficients.withColumn("found", F.lit(found)))
    return _rounded(harmonize.union_shared(parts))


def model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, degrees of freedom, deviance and AIC of the model by city."""
    data = model.dark_data(model_cells(spark, sf_dir))
    return _rounded(model.fit_dark_model(data, by_city=True).fit.drop("iterations"))


def model_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of darkness in both models, from one checkpoint of the cells."""
    data = model.dark_data(model_cells(spark, sf_dir))
    parts = [
        model.dark_estimate(model.fit_dark_model(data, by_city)).withColumn("by_city", F.lit(by_city))
        for by_city in (False, True)
    ]
    return _rounded(harmonize.union_shared(parts))


def model_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted sums per light and per city, which equal the observed ones at the optimum."""
    data = model.dark_data(model_cells(spark, sf_dir))
    fitted = model.fitted_cells(data, model.fit_dark_model(data, by_city=True))
    sums = fitted.groupingSets([["is_dark"], ["city"]], "is_dark", "city").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("fitted")).alias("black")
    )
    return _rounded(sums)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "column_inventory": column_inventory,
    "harmonized_union": harmonized_union,
    "csv_files": csv_files,
    "rejected_rows": rejected_rows,
    "replaced_city": replaced_city,
    "census_files": census_files,
    "indexed_file": indexed_file,
    "parsed_stops": parsed_stops,
    "completeness": _on_all(clean.completeness),
    "column_report": column_report,
    "clean_stops": clean_stops,
    "labelled_stops": labelled_stops,
    "first_rows": first_rows,
    "stage_counts": stage_counts,
    "stage_completeness": stage_completeness,
    "date_span": _on_all(profile.date_span),
    "city_counts": _on_year(lambda df: _ranked(profile.frequency_by_key(df, "city"))),
    "race_counts": _on_year(lambda df: _ranked(profile.frequency(df, "subject_race"))),
    "distinct_city_race": _on_year(
        lambda df: profile.distinct_values(df, "city", "subject_race")
    ),
    "type_share": _on_year(lambda df: profile.relative_frequency(df, "type")),
    "sex_share": _on_year(profile.relative_sex_frequency),
    "race_share": _on_year(lambda df: profile.relative_frequency(df, "subject_race")),
    "race_share_by_city": _on_year(profile.race_share_by_city),
    "sex_share_by_city": _on_year(profile.sex_share_by_city),
    "hour_pct": _on_year(lambda df: _ranked(profile.hour_percent(df))),
    "hour_pct_from_cells": profile_from_cells,
    "weekday_pct": _on_year(profile.weekday_percent),
    "weekday_pct_from_cells": weekday_from_cells,
    "age_hist": _on_year(histogram.age_histogram),
    "date_hist": _on_year(histogram.date_histogram),
    "race_matrix": _race_matrix,
    "census_by_city": census_by_city,
    "population_share": population_share,
    "per_capita": per_capita,
    "per_capita_gap": per_capita_gap,
    "rate_means_gap": rate_means_gap,
    "per_capita_report": per_capita_report,
    "rate_means": rate_means,
    "rate_interval": rate_interval,
    "rate_ratio": rate_ratio,
    "solar_table": solar_table,
    "dusk_extremes": dusk_extremes,
    "twilight_stops": twilight_stops,
    "twilight_stages": twilight_stages,
    "twilight_counts": twilight_counts,
    "dark_share_slice": dark_share_slice,
    "dark_share_overall": dark_share_overall,
    "dark_share_total": dark_share_total,
    "model_cells": model_cells,
    "spline_knots": spline_knots,
    "spline_basis": spline_basis,
    "model_base": model_base,
    "model_city": model_city,
    "model_city_fewer": model_city_fewer,
    "model_separated": model_separated,
    "model_fit": model_fit,
    "model_estimates": model_estimates,
    "model_margins": model_margins,
}
