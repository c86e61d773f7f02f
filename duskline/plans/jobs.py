"""The jobs: merge, overview, profile, rates, twilight test.

Each job reads saved Parquet, is one lazy plan per result table, and can be run
again: it replaces its own output and nothing else.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duskline.fixed import KEY_COLUMNS
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
from duskline.plans.study import Study
from duskline.sources.lineage import remove_folder, run_folder
from duskline.sources.readers import (
    MALFORMED,
    SOURCE_FILE,
    Paths,
    city_columns,
    read_cities,
    read_table,
    read_text_table,
)
from duskline.sources.writers import changed_sources, replace_parts, table_columns, write_table

# Columns of the merged table that are not read from the files.
TYPED_COLUMNS = ("second_of_day", "year")


def inventory_table(spark: SparkSession, paths: Paths, out: str) -> None:
    """Which city files hold which column; reads headers only, all of them in one job."""
    columns = city_columns(spark, paths)
    write_table(harmonize.inventory_of_columns(spark, columns), out)


def merge_stops(
    spark: SparkSession,
    paths: Paths,
    out: str,
    rebalance: bool = True,
    multi_line: bool = False,
    rejects: str | None = None,
    most_rejected: float = 0.01,
) -> list[str]:
    """City files to one typed table, partitioned so that a study reads its year only.

    The parts of the given cities are replaced, those of other cities stay as they are. A city whose
    files are those of its last run is left out; the cities that were read are given back. Where the
    table is there already, its columns stay: a city's further columns are left out, and
    those it lacks are null.

    A row that cannot be read stops the job. With ``rejects``, the path of a second table, such rows go there
    with their file, text and reasons, and the job stops before the merged table is touched
    if their share is larger than ``most_rejected``.

    ``rebalance`` keeps the number of files small whatever the order of the rows; leave
    it out where every file is in order of time.
    """
    changed = changed_sources(spark, out, "city", paths)
    if rejects:
        again = changed_sources(spark, rejects, "city", paths)
        changed = [city for city in paths if city in changed or city in again]
    if not changed:
        return []
    read = {city: paths[city] for city in changed}
    folder = run_folder(spark, "merge")
    try:
        cities = read_cities(spark, read, multi_line, not rejects, f"{folder}/lines")
        merged = harmonize.merge_cities(cities)
        if known := table_columns(spark, out):
            kept = [c for c in (MALFORMED, SOURCE_FILE) if rejects]
            merged = harmonize.with_columns_of(merged, [c for c in known if c not in TYPED_COLUMNS] + kept)
        typed = clean.checked_stops(merged) if rejects else clean.typed_stops(merged)
        write_table(typed.withColumn("year", F.year("date")), f"{folder}/staged")
        staged = read_table(spark, f"{folder}/staged")
        if rejects:
            _set_apart(staged, rejects, read, most_rejected)
            staged = clean.good_stops(staged)
        replace_parts(staged, out, ["city", "year"], read, rebalance)
    finally:
        remove_folder(spark, folder)
    return changed


def _set_apart(checked: DataFrame, rejects: str, paths: Paths, most: float) -> None:
    """Write the rows that cannot be read; too many of them stop the job."""
    count = checked.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("reasons") > 0).alias("bad")
    ).first()
    replace_parts(clean.rejected_rows(checked), rejects, ["city"], paths)
    if count["bad"] > most * count["rows"]:
        raise ValueError(
            f"{count['bad']} of {count['rows']} rows cannot be read, more than {most:.2%}; they are in {rejects}"
        )


def census_table(
    spark: SparkSession, first: str, second: str, out: str, multi_line: bool = False
) -> None:
    parts = [read_text_table(spark, path, multi_line) for path in (first, second)]
    wide = census.join_parts(*parts)
    write_table(census.census_by_city(wide), out)


def study_stops(stops: DataFrame, study: Study) -> DataFrame:
    """Complete stops of the study's period, without the cities it leaves out."""
    kept = filters.in_period(clean.drop_incomplete(stops), study.period)
    return clean.with_clock_fields(filters.without_cities(kept, study.without_cities))


def study_stages(study: Study) -> dict[str, Column]:
    """The filters between the merged table and the stops of the twilight test."""
    keys = [F.col(name).isNotNull() for name in KEY_COLUMNS]
    return {
        "read": F.lit(True),
        "complete": reduce(and_, keys),
        "in period": F.col("date").between(study.period.start, study.period.end),
        "listed cities": ~F.col("city").isin(*study.without_cities),
        "listed races": F.col("subject_race").isin(*study.races),
        "vehicular": F.col("type") == "vehicular",
    }


def overview(spark: SparkSession, merged: str, out: str, study: Study) -> None:
    """What the merged table holds: dates per city, rows and values after each filter.

    The only job that reads all years, as it is there to choose one. One pass makes
    count cells, from which the tables follow.
    """
    stages = study_stages(study)
    stops = read_table(spark, merged).drop("year")
    write_table(profile.stage_cells(stops, stages), f"{out}/stage_cells")
    cells = read_table(spark, f"{out}/stage_cells")
    write_table(profile.date_span(cells), f"{out}/date_span")
    write_table(profile.cell_counts(cells, stages), f"{out}/stage_counts")
    write_table(profile.cell_completeness(cells, stages), f"{out}/stage_completeness")


def export_csv(spark: SparkSession, stops: str, out: str) -> None:
    """A saved stop table as text for other programs, with labels on unknown values."""
    table = read_table(spark, stops).drop("second_of_day", "year")
    write_table(clean.label_unknown(table), out, file_format="csv")


def profile_tables(cells: DataFrame, days: DataFrame, ages: DataFrame) -> dict[str, DataFrame]:
    """Every profile table, from count cells."""
    return {
        "date_span": profile.date_span(days),
        "city_counts": profile.frequency_by_key(days, "city", "n"),
        "type_share": profile.relative_frequency(cells, "type", "n"),
        "sex_share": profile.relative_sex_frequency(cells, "n"),
        "race_share": profile.relative_frequency(cells, "subject_race", "n"),
        "race_share_by_city": profile.race_share_by_city(cells, weight="n"),
        "sex_share_by_city": profile.sex_share_by_city(cells, weight="n"),
        "hour_percent": profile.hour_percent(cells, "n"),
        "weekday_percent": profile.weekday_percent(days, "n"),
        "date_histogram": histogram.date_histogram(days, weight="n"),
        "age_histogram": histogram.age_histogram(ages, weight="n"),
    }


def profile_study(spark: SparkSession, merged: str, out: str, study: Study) -> None:
    """One narrow pass makes count cells of three kinds; all tables follow from them."""
    stops = study_stops(read_table(spark, merged), study)
    write_table(profile.all_cells(stops), f"{out}/cells")
    saved = read_table(spark, f"{out}/cells")
    cells, days, ages = (profile.cells_of(saved, kind) for kind in ("profile", "day", "age"))
    for name, table in profile_tables(cells, days, ages).items():
        write_table(table, f"{out}/{name}")


def rates_study(spark: SparkSession, merged: str, census_path: str, out: str, study: Study) -> None:
    """Clean stops of the listed races, their counts, and rates per head.

    One pass over the clean stops makes count cells; all counts follow from them.
    """
    stops = filters.with_races(study_stops(read_table(spark, merged), study), study.races)
    write_table(stops.drop("hour", "weekday"), f"{out}/clean_stops", ["city", "year"])
    stops = read_table(spark, f"{out}/clean_stops")
    cells = profile.profile_cells(stops, ("city", "type", "subject_race", "date"))
    write_table(cells, f"{out}/race_cells")
    cells = read_table(spark, f"{out}/race_cells")
    write_table(rates.race_matrix(cells, study.races, "n"), f"{out}/race_counts")
    population = census.census_report(read_table(spark, census_path))
    write_table(rates.population_share(population, study.races), f"{out}/population")
    counts = read_table(spark, f"{out}/race_counts")
    heads = rates.per_capita(counts, read_table(spark, f"{out}/population"), study.races)
    write_table(heads, f"{out}/per_capita")
    report = rates.per_capita_report(read_table(spark, f"{out}/per_capita"), study.races)
    write_table(report, f"{out}/per_capita_report")
    means = rates.rate_means(read_table(spark, f"{out}/per_capita"), study.races)
    write_table(means, f"{out}/rate_means")
    means = read_table(spark, f"{out}/rate_means")
    write_table(rates.rate_interval(means), f"{out}/rate_interval")
    write_table(rates.rate_ratio(means), f"{out}/rate_ratio")


def twilight_study(spark: SparkSession, out: str, study: Study) -> None:
    """The twilight test on the clean stops that ``rates_study`` wrote."""
    cells = filters.of_type(read_table(spark, f"{out}/race_cells"))
    races = profile.relative_frequency(cells, "subject_race", "n")
    write_table(races, f"{out}/vehicular_race_share")
    write_table(profile.frequency_by_key(cells, "city", "n"), f"{out}/vehicular_counts")
    evenings = filters.in_cities(cells, study.twilight_cities)
    write_table(sunset.solar_table(evenings, study.twilight_points), f"{out}/solar_table")
    days = read_table(spark, f"{out}/solar_table")
    write_table(sunset.dusk_extremes(days), f"{out}/dusk_extremes")

    # The only scan of the stops and their only join: what follows reads the evenings.
    stops = filters.in_cities(filters.of_type(read_table(spark, f"{out}/clean_stops")), study.twilight_cities)
    stages = twilight.twilight_stages()
    lit = twilight.with_light(stops, days).where(stages["between twilights"])
    write_table(lit, f"{out}/evening_stops")
    evening = read_table(spark, f"{out}/evening_stops")
    counts = profile.stage_counts(evening, stages)
    vehicular = evenings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    first = F.when(F.col("step") == 0, F.lit(vehicular)).otherwise(F.col("rows"))
    write_table(counts.withColumn("rows", first), f"{out}/twilight_stages")
    kept = evening.where(stages["not ambiguous"] & stages["two races"])
    write_table(kept, f"{out}/twilight_stops")
    kept = read_table(spark, f"{out}/twilight_stops")
    write_table(profile.frequency_by_key(kept, "city"), f"{out}/twilight_counts")
    window = filters.in_clock_window(kept)
    write_table(twilight.dark_share_with_total(window), f"{out}/dark_share")
    write_table(twilight.model_cells(kept), f"{out}/model_cells")

    data = model.dark_data(read_table(spark, f"{out}/model_cells"))
    for name, by_city in (("model_base", False), ("model_city", True)):
        fitted = model.fit_dark_model(data, by_city)
        write_table(fitted.coefficients, f"{out}/{name}")
        write_table(fitted.fit, f"{out}/{name}_fit")


def run_study(
    spark: SparkSession, merged: str, census_path: str, out: str, study: Study
) -> None:
    overview(spark, merged, f"{out}/overview", study)
    profile_study(spark, merged, f"{out}/profile", study)
    rates_study(spark, merged, census_path, f"{out}/rates", study)
    twilight_study(spark, f"{out}/rates", study)
