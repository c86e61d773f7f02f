import math

import pytest
from conftest import rows

from duskline.operators import census, rates

FACT = "Fact string, `Fact Note` string"


def wide(spark, city, total, black, white="60%"):
    heading = f"`{city} city, California` string, `Value Note for {city} city, California` string"
    facts = [
        ("Population, Census, April 1, 2010", total),
        ("Households", "12"),
        ("Black or African American alone, percent", black),
        ("Female persons, percent", "50%"),
        ("Hispanic or Latino, percent", "1%"),
        ("White alone, not Hispanic or Latino, percent", white),
        (None, None),
    ]
    return spark.createDataFrame([(f, None, v, None) for f, v in facts], f"{FACT}, {heading}")


def test_census_rows_are_typed_people(spark):
    parts = wide(spark, "B", "2,000", "2%"), wide(spark, "A", "1,000", "10.5%").orderBy("Fact")
    table = census.census_by_city(census.join_parts(*parts))
    found = rows(table.select("City", "Total", "black", "white"), "City")
    assert found == [("A", 1000.0, 105.0, 600.0), ("B", 2000.0, 40.0, 1200.0)]
    assert census.census_report(table).columns == [
        "city",
        "total_pop",
        "black_pop",
        "hispanic_pop",
        "white_pop",
    ]


def test_census_parts_must_have_the_same_facts(spark):
    left = wide(spark, "A", "1,000", "10%")
    right = wide(spark, "B", "2,000", "2%").where("Fact <> 'Female persons, percent'")
    with pytest.raises(Exception, match="fact missing"):
        census.census_by_city(census.join_parts(left, right)).collect()


def test_census_text_that_is_no_number_stops_the_job(spark):
    parts = wide(spark, "A", "1,000", "10%", white="Z"), wide(spark, "B", "2,000", "2%")
    with pytest.raises(Exception, match="not a double: Z"):
        census.census_by_city(census.join_parts(*parts)).collect()


def test_census_facts_must_be_listed_once(spark):
    left, right = wide(spark, "A", "1,000", "10%"), wide(spark, "B", "2,000", "2%")
    again = left.union(left.where("Fact = 'Female persons, percent'"))
    with pytest.raises(Exception, match="fact listed twice: Female"):
        census.census_by_city(census.join_parts(again, right)).collect()
    kept = "Fact <> 'Female persons, percent'"
    with pytest.raises(Exception, match="fact not listed: Female"):
        census.census_by_city(census.join_parts(left.where(kept), right.where(kept))).collect()


def test_matrix_is_null_where_a_city_lacks_a_race(spark):
    stops = spark.createDataFrame(
        [("A", "black"), ("A", "white"), ("B", "white"), ("C", "other")],
        "city string, subject_race string",
    )
    assert rows(rates.race_matrix(stops), "city") == [("A", 1, None, 1), ("B", None, None, 1)]


@pytest.fixture
def heads(spark):
    counts = spark.createDataFrame(
        [("A", 10, 1, 20), ("B", 30, 1, 30)], "city string, black long, hispanic long, white long"
    )
    pop = spark.createDataFrame(
        [("A", 600.0, 100.0, 10.0, 400.0), ("B", 400.0, 100.0, 10.0, 200.0)],
        "city string, total_pop double, black_pop double, hispanic_pop double, white_pop double",
    )
    return rates.per_capita(counts, rates.population_share(pop))


def test_per_capita_and_shares(heads):
    first = heads.orderBy("city").first()
    assert first.black_per_cap == pytest.approx(0.1) and first.white_per_cap == pytest.approx(0.05)
    assert first.black_prop == pytest.approx(1 / 6)
    assert rates.per_capita_report(heads).columns == [
        "city",
        "black_per_cap",
        "hispanic_per_cap",
        "white_per_cap",
    ]


def test_interval_and_ratio(heads):
    means = rates.rate_means(heads)
    one = means.first()
    assert (one.black_mean, one.white_mean) == (pytest.approx(0.2), pytest.approx(0.1))
    assert (one.black_pop_sum, one.white_pop_sum) == (200.0, 600.0)
    half = 2.58 * math.sqrt(0.1 * 0.9 / 600 + 0.2 * 0.8 / 200)
    interval = {r.other: r for r in rates.rate_interval(means).collect()}["black"]
    assert interval.difference == pytest.approx(-0.1, abs=1e-12)
    assert interval.lower_bound == pytest.approx(-0.1 - half, abs=1e-12)
    assert interval.upper_bound == pytest.approx(-0.1 + half, abs=1e-12)
    ratio = {r.other: r.ratio for r in rates.rate_ratio(means).collect()}
    assert ratio["black"] == pytest.approx(2.0)


def test_a_missing_rate_makes_what_uses_it_unknown(spark, heads):
    counts = spark.createDataFrame([("C", 5, 1, 5)], "city string, black long, hispanic long, white long")
    pop = heads.select("city", "total_pop", "black_pop", "hispanic_pop", "white_pop")
    more = heads.select("city", "black", "hispanic", "white").unionByName(counts)
    means = rates.rate_means(rates.per_capita(more, pop))
    assert set(means.first()) == {None}
    assert all(r.lower_bound is None for r in rates.rate_interval(means).collect())
    assert all(r.ratio is None for r in rates.rate_ratio(means).collect())
