import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from duskline.functions import clock
from duskline.operators import clean, filters
from duskline.plans.jobs import study_stops
from duskline.plans.study import STUDY_2014, STUDY_2017

RAW = (
    "date string, time string, lat string, lng string, subject_age string, subject_sex string, "
    "subject_race string, type string, outcome string, search_conducted string, "
    "contraband_found string, city string"
)


def raw(spark, *stops):
    full = [
        (d, t, None, None, age, sex, race, kind, None, None, None, city)
        for d, t, age, sex, race, kind, city in stops
    ]
    return spark.createDataFrame(full, RAW)


@pytest.fixture
def stops(spark):
    return clean.typed_stops(
        raw(
            spark,
            ("2014-01-01", None, None, None, "white", "vehicular", "Oakland"),
            ("2014-12-31", "10:00:00", "30", "male", "black", "pedestrian", "Oakland"),
            ("2015-01-01", "10:00:00", "30", "male", "black", "vehicular", "Oakland"),
            ("2014-06-01", "10:00:00", "30", "male", None, "vehicular", "Oakland"),
            ("2014-06-01", "10:00:00", "30", "male", "unknown", "vehicular", "Oakland"),
            ("2014-06-01", "10:00:00", "30", "male", "white", "vehicular", "Santa Ana"),
        )
    )


def test_study_keeps_both_ends_and_listed_races(stops):
    kept = filters.with_races(study_stops(stops, STUDY_2014), STUDY_2014.races)
    assert rows(kept.select("date", "subject_race"), "date") == [
        (day("2014-01-01"), "white"),
        (day("2014-12-31"), "black"),
    ]


def test_labels(stops):
    labelled = clean.label_unknown(study_stops(stops, STUDY_2014)).orderBy("date").first()
    assert (labelled.time, labelled.subject_sex, labelled.lat, labelled.outcome) == ("N/A",) * 4
    assert labelled.subject_age == -1 and labelled.hour == -1
    assert labelled.subject_race == "white"


def test_completeness_after_dropping(stops):
    kept = clean.drop_incomplete(stops)
    counts = dict(rows(clean.completeness(kept)))
    assert {counts[c] for c in ("date", "subject_race", "type", "city")} == {kept.count()} == {5}
    assert counts["time"] == 4 and counts["lat"] == 0


def test_second_study_leaves_out_two_cities(spark):
    stops = clean.typed_stops(
        raw(
            spark,
            *[
                ("2017-12-31", "10:00:00", "30", "male", "white", "vehicular", city)
                for city in ("Oakland", "San Diego", "Santa Ana")
            ],
        )
    )
    assert [r.city for r in study_stops(stops, STUDY_2017).collect()] == ["Oakland"]


@pytest.mark.parametrize("column, text", [("date", "soon"), ("subject_age", "old")])
def test_unreadable_text_fails_unless_lenient(spark, column, text):
    one = raw(spark, ("2014-01-01", "10:00:00", "30", "male", "white", "vehicular", "Oakland"))
    bad = one.withColumn(column, F.lit(text))
    assert clean.typed_stops(bad, strict=False).first()[column] is None
    with pytest.raises(Exception, match="not a (date|double)"):
        clean.typed_stops(bad).collect()


def test_strictness_does_not_depend_on_the_ansi_mode(spark):
    one = raw(spark, ("01/02/2014", "10:00:00", "30", "male", "white", "vehicular", "Oakland"))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="not a date: 01/02/2014"):
            clean.typed_stops(one).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_clock_fields(spark):
    texts = ["18:31:59", "9:05:00", "00:00:00", "23:59:59", "N/A", "", "25:00:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        clock.second_of_day(F.col("t"), strict=False).alias("s")
    )
    found = df.select(clock.hour_of(F.col("s")), clock.minute_of(F.col("s"))).collect()
    assert [tuple(r) for r in found] == [
        (18, 1111),
        (9, 545),
        (0, 0),
        (23, 1439),
        (None, None),
        (None, None),
        (None, None),
        (None, None),
    ]


@pytest.mark.parametrize("text", ["25:99:00", "18", "soon"])
def test_a_text_that_is_no_time_stops_the_job(spark, text):
    df = spark.createDataFrame([(text,), ("18:31:59",), (None,)], "t string")
    with pytest.raises(Exception, match=f"not a time: {text}"):
        df.select(clock.second_of_day(F.col("t"))).collect()
    found = df.select(clock.second_of_day(F.col("t"), strict=False)).collect()
    assert [r[0] for r in found] == [None, 66719, None]


def test_weekday_starts_on_monday(spark):
    df = spark.createDataFrame([(day("2014-01-01"),), (day("2014-01-06"),)], "date date")
    assert [r[0] for r in df.select(clock.weekday(F.col("date"))).collect()] == [2, 0]


def test_age_and_hour_filters(spark):
    df = spark.createDataFrame(
        [(0.0, 0), (-1.0, -1), (None, None), (1.0, 23)], "subject_age double, hour int"
    )
    assert [r.subject_age for r in filters.known_age(df).collect()] == [1.0]
    assert [r.hour for r in filters.known_hour(df).collect()] == [0, 23]


def test_clock_window_is_open(spark):
    df = spark.createDataFrame(
        [("18:30:00",), ("18:30:01",), ("18:44:59",), ("18:45:00",)], "time string"
    ).withColumn("second_of_day", clock.second_of_day(F.col("time")))
    assert [r.time for r in filters.in_clock_window(df).collect()] == ["18:30:01", "18:44:59"]


def test_schema_report_and_first_rows(spark, stops):
    report = dict(rows(clean.schema_report(stops)))
    assert report["date"] == "date" and report["subject_age"] == "double"
    first = clean.first_rows(stops.select("date", "city"), "date", rows=2)
    assert [r.date for r in first.collect()] == [day("2014-01-01"), day("2014-06-01")]
