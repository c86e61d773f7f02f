import numpy as np
import pytest
from conftest import day, final_plan, rows
from pyspark.sql import functions as F

from duskline.operators import histogram, profile, rates

STOPS = "city string, subject_race string, subject_sex string, hour int, weekday int, date date"


@pytest.fixture
def stops(spark):
    data = [
        ("A", "white", "male", 1, 0, day("2014-01-06")),
        ("A", "white", "female", 1, 1, day("2014-01-07")),
        ("A", "black", None, 2, 1, day("2014-01-07")),
        ("A", "unknown", None, None, 1, day("2014-01-07")),
        ("B", "hispanic", "male", 23, 6, day("2014-01-12")),
    ]
    return spark.createDataFrame(data, STOPS)


def test_race_share_leaves_out_unlisted_and_shows_zero(stops):
    share = {r.city: r for r in profile.race_share_by_city(stops).collect()}
    assert share["A"].white == pytest.approx(2 / 3) and share["A"].black == pytest.approx(1 / 3)
    assert share["A"].hispanic == 0.0 and share["A"].asian_pacific_islander == 0.0
    assert share["B"].hispanic == 1.0


def test_sex_share_counts_unknown_only_overall(stops):
    city_a = stops.where("city = 'A'")
    overall = {r.subject_sex: r.share for r in profile.relative_sex_frequency(city_a).collect()}
    assert overall == {"male": 0.25, "female": 0.25, "N/A": 0.5}
    by_city = rows(profile.sex_share_by_city(city_a))
    assert by_city == [("A", 0.5, 0.5)]


def test_frequency_orders(stops):
    assert rows(profile.frequency(stops, "subject_race"))[0] == ("white", 2)
    assert rows(profile.frequency_by_key(stops, "city")) == [("A", 4), ("B", 1)]
    assert [r[0] for r in rows(profile.frequency(stops, "hour"))] == [1, 2, 23]


def test_percent_by_city_sums_to_100(stops):
    hours = rows(profile.hour_percent(stops))
    assert hours == [("A", 1, pytest.approx(200 / 3)), ("A", 2, pytest.approx(100 / 3)), ("B", 23, 100.0)]
    assert rows(profile.weekday_percent(stops))[0] == ("A", 0, 25.0)


def test_cells_give_the_same_tables_as_stops(stops):
    stops = stops.withColumn("type", F.lit("vehicular"))
    cells, days = profile.profile_cells(stops), profile.day_cells(stops)
    pairs = [
        (profile.race_share_by_city(stops), profile.race_share_by_city(cells, weight="n")),
        (profile.sex_share_by_city(stops), profile.sex_share_by_city(cells, weight="n")),
        (profile.hour_percent(stops), profile.hour_percent(cells, "n")),
        (profile.weekday_percent(stops), profile.weekday_percent(days, "n")),
        (
            profile.relative_frequency(stops, "subject_race"),
            profile.relative_frequency(cells, "subject_race", "n"),
        ),
        (profile.relative_sex_frequency(stops), profile.relative_sex_frequency(cells, "n")),
        (histogram.date_histogram(stops), histogram.date_histogram(days, weight="n")),
        (profile.date_span(stops), profile.date_span(days)),
        (rates.race_matrix(stops), rates.race_matrix(cells, weight="n")),
    ]
    for from_stops, from_cells in pairs:
        assert sorted(rows(from_stops), key=repr) == sorted(rows(from_cells), key=repr)


def test_date_span_has_an_overall_row(stops):
    span = {r.city: (r.first_date, r.last_date) for r in profile.date_span(stops).collect()}
    assert span["A"] == (day("2014-01-06"), day("2014-01-07"))
    assert span[None] == (day("2014-01-06"), day("2014-01-12"))


def test_stage_counts_never_rise(stops):
    stages = {
        "read": F.lit(True),
        "race known": F.col("subject_race") != "unknown",
        "sex known": F.col("subject_sex").isNotNull(),
        "male": F.col("subject_sex") == "male",
    }
    assert [r.rows for r in profile.stage_counts(stops, stages).collect()] == [5, 4, 3, 2]


def test_relative_frequency_reads_the_data_once(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for df in (
        profile.relative_frequency(events, "event_type"),
        histogram.histogram(events, "user_id", 20),
    ):
        executed = final_plan(df).split("Initial Plan")[0]
        assert "ReusedExchange" in executed


def test_age_histogram(spark):
    ages = spark.createDataFrame([(0.0,), (1.0,), (21.0,), (None,)], "subject_age double")
    bins = rows(histogram.age_histogram(ages), "bin")
    assert [r[3] for r in bins] == [1] + [0] * 18 + [1]
    assert bins[0][1:3] == (1.0, 2.0) and bins[19][2] == 21.0


@pytest.mark.parametrize("seed, bins", [(1, 20), (2, 10), (3, 7)])
def test_histogram_equals_brute_force(spark, seed, bins):
    values = np.random.default_rng(seed).integers(1, 99, 500).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts, edges = np.histogram(values, bins)
    found = rows(histogram.histogram(df, "x", bins), "bin")
    assert [r[3] for r in found] == counts.tolist()
    assert np.allclose([r[1] for r in found] + [found[-1][2]], edges)


def test_histogram_of_one_value_and_of_nothing(spark):
    one = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    counts, edges = np.histogram([5.0, 5.0], 4)
    found = rows(histogram.histogram(one, "x", 4), "bin")
    assert [r[3] for r in found] == counts.tolist() and found[0][1] == edges[0]
    nothing = rows(histogram.histogram(one.where("x > 9"), "x", 4), "bin")
    assert [r[1:] for r in nothing] == [(None, None, 0)] * 4
