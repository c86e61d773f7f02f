import pytest
from conftest import day, final_plan, plan, rows
from pyspark.sql import functions as F

from duskline.operators import sunset, twilight
from duskline.operators.filters import Period
from duskline.plans.study import Study

SOLAR = {
    "Bakersfield": "16:55:26 17:23:38 19:08:44 19:34:07 20:15:34 20:45:30 17:01:50 17:28:11 16:48:29 17:16:49",
    "Los Angeles": "16:55:43 17:23:23 19:05:35 19:30:33 20:08:48 20:38:03 17:00:46 17:26:40 16:48:51 17:16:39",
    "Oakland": "17:01:55 17:31:12 19:21:53 19:48:04 20:35:41 21:07:03 17:10:54 17:38:09 16:54:47 17:24:14",
    "San Diego": "16:54:41 17:21:51 19:01:11 19:25:47 20:00:55 20:29:32 16:58:26 17:23:55 16:47:54 17:15:11",
    "San Francisco": "17:02:35 17:31:51 19:22:28 19:48:39 20:36:11 21:07:32 17:11:33 17:38:47 16:55:28 17:24:54",
    "San Jose": "17:01:40 17:30:43 19:20:19 19:46:20 20:32:44 21:03:49 17:10:08 17:37:12 16:54:34 17:23:47",
}
DAYS = ["2014-01-01", "2014-03-20", "2014-06-21", "2014-11-02", "2014-12-21"]


def test_solar_table(spark):
    stops = spark.createDataFrame(
        [(city, day(d)) for city in [*SOLAR, "Nowhere"] for d in DAYS * 2], "city string, date date"
    )
    table = sunset.solar_table(stops)
    found = {(r.city, str(r.date)): (r.sunset, r.dusk) for r in table.collect()}
    expected = {
        (city, d): tuple(times.split()[2 * i : 2 * i + 2])
        for city, times in SOLAR.items()
        for i, d in enumerate(DAYS)
    }
    assert found == expected
    assert table.columns == ["city", "date", "sunset", "dusk", "sunset_minute", "dusk_minute"]
    one = table.where("city = 'Oakland' and date = '2014-06-21'").first()
    assert (one.sunset_minute, one.dusk_minute) == (20 * 60 + 35, 21 * 60 + 7)


def test_no_sunset_in_polar_summer(spark):
    stops = spark.createDataFrame([("North", day("2014-06-21"))], "city string, date date")
    points = [("North", 78.2, 15.6, "Arctic/Longyearbyen")]
    one = sunset.solar_table(stops, points).first()
    assert one.sunset is None and one.dusk_minute is None


def test_a_city_has_one_point(spark):
    with pytest.raises(ValueError):
        sunset.city_points(spark, [("A", 1.0, 1.0, "UTC"), ("A", 2.0, 1.0, "UTC")])


def test_dusk_extremes_keep_ties(spark):
    table = spark.createDataFrame(
        [("A", "17:16:00"), ("A", "17:16:00"), ("A", "18:00:00"), ("A", "21:07:00")],
        "city string, dusk string",
    )
    assert sorted(r.dusk for r in sunset.dusk_extremes(table).collect()) == [
        "17:16:00",
        "17:16:00",
        "21:07:00",
    ]


@pytest.fixture
def days(spark):
    return spark.createDataFrame(
        [
            ("A", day("2014-01-01"), "16:40:00", "17:10:00", 1000, 1030),
            ("A", day("2014-01-02"), "18:20:00", "18:50:00", 1100, 1130),
        ],
        "city string, date date, sunset string, dusk string, sunset_minute int, dusk_minute int",
    )


@pytest.fixture
def stops(spark):
    data = [
        (1, 1030, "black"),
        (1, 1031, "white"),
        (1, 1130, "white"),
        (1, 1131, "white"),
        (1, 1029, "white"),
        (2, 1100, "black"),
        (2, 1101, "black"),
        (2, 1130, "white"),
        (2, 1060, "hispanic"),
        (2, None, "white"),
    ]
    return spark.createDataFrame(
        [("A", day(f"2014-01-0{d}"), None if m is None else m * 60 + 30, r) for d, m, r in data],
        "city string, date date, second_of_day int, subject_race string",
    )


def test_twilight_boundaries(stops, days):
    kept = twilight.twilight_stops(stops, days)
    found = rows(kept.select(F.dayofmonth("date"), "minute", "subject_race", "is_dark", "is_black"))
    assert sorted(found) == [
        (1, 1030, "black", False, True),
        (1, 1031, "white", True, False),
        (1, 1130, "white", True, False),
        (2, 1100, "black", False, True),
        (2, 1130, "white", False, False),
    ]
    first = kept.where("minute = 1031").first()
    assert (first.min_dusk_minute, first.max_dusk_minute, first.minutes_after_dark) == (1030, 1130, 1)


def test_bounds_come_from_all_days_with_stops(stops, days):
    only_others = stops.where("date = '2014-01-01' or subject_race = 'hispanic'")
    kept = twilight.twilight_stops(only_others, days)
    assert {r.max_dusk_minute for r in kept.collect()} == {1130}


def test_cells_give_what_stops_give(stops, days):
    cells = twilight.evening_cells(stops.union(stops))
    lit = twilight.with_light(cells, days).where(twilight.between_twilights() & twilight.not_ambiguous())
    kept = twilight.twilight_stops(stops.union(stops), days)
    two = lit.where("subject_race <> 'hispanic'")
    assert sorted(rows(twilight.model_cells(two, "n"))) == sorted(rows(twilight.model_cells(kept)))
    assert sorted(rows(twilight.dark_share(two, weight="n"))) == sorted(rows(twilight.dark_share(kept)))


def test_a_twilight_city_needs_a_point():
    with pytest.raises(ValueError, match="Fresno"):
        Study(Period.of_year(2014), (), ("Oakland", "Fresno"))


def test_a_hot_day_is_split_when_the_solar_table_is_not_broadcast(spark, tmp_path):
    """A third of the stops on one day of one city; results stay whole."""
    many = spark.range(300_000).selectExpr(
        "if(id % 3 = 0, 'HOT', concat('C', id % 40)) AS city",
        "if(id % 3 = 0, DATE '2014-06-01', date_add(DATE '2014-01-01', CAST(id % 300 AS INT))) AS date",
        "CAST(60000 + id * 7 % 20000 AS INT) AS second_of_day",
        "if(id % 2 = 0, 'black', 'white') AS subject_race",
        "repeat(sha2(CAST(id AS STRING), 256), 2) AS note",
    )
    many.repartition(16).write.parquet(str(tmp_path / "stops"))
    many = spark.read.parquet(str(tmp_path / "stops"))
    days = many.select("city", "date").distinct().selectExpr(
        "*", "1000 AS sunset_minute", "1030 AS dusk_minute", "'17:10:00' AS dusk"
    )
    days.write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lit = twilight.with_light(many, days)
        assert lit.count() == 300_000
        assert "skew=true" in final_plan(lit)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_dark_share(spark):
    kept = spark.createDataFrame(
        [("A", True, True), ("A", True, False), ("A", False, False), ("B", True, False), ("B", True, False)],
        "city string, is_dark boolean, is_black boolean",
    )
    by_city = {(r.city, r.is_dark): r.prop_black for r in twilight.dark_share(kept, "city").collect()}
    assert by_city == {("A", True): 0.5, ("A", False): 0.0, ("B", True): 0.0}
    overall = {r.is_dark: (r.prop_black, r.n) for r in twilight.dark_share(kept).collect()}
    assert overall == {True: (0.25, 4), False: (0.0, 1)}
    total = {(r.city, r.is_dark): (r.prop_black, r.n) for r in twilight.dark_share_with_total(kept).collect()}
    assert total[(None, True)] == (0.25, 4) and total[("A", True)] == (0.5, 2)


def test_cells_add_up(stops, days):
    kept = twilight.twilight_stops(stops, days)
    assert twilight.model_cells(kept).agg(F.sum("n")).first()[0] == kept.count()


def test_sun_equals_a_published_example(spark):
    """Sunset 15:46:57 and dusk 16:19:36 UTC on 5 March 2013 at 50.5 N, 30.5 E."""
    stops = spark.createDataFrame([("P", day("2013-03-05"))], "city string, date date")
    one = sunset.solar_table(stops, [("P", 50.5, 30.5, "UTC")]).first()
    assert (one.sunset, one.dusk) == ("15:46:57", "16:19:36")
