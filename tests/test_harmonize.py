import pytest
from conftest import rows
from pyspark.sql import functions as F

from duskline.operators import harmonize
from duskline.plans.jobs import merge_stops
from duskline.sources.readers import MALFORMED, drop_index, read_cities, read_table, read_text_table
from duskline.sources.writers import write_table

WANTED = ["date", "time", "type"]


@pytest.fixture
def sources(spark):
    a = spark.createDataFrame(
        [("1", "2014-01-01", "10:00:00", "vehicular", "q"), ("1", "2014-01-01", "10:00:00", "vehicular", "q")],
        "raw_row_number string, date string, time string, type string, raw_x string",
    )
    b = spark.createDataFrame(
        [("1", "2014-01-02", "pedestrian", "7")],
        "raw_row_number string, date string, type string, beat string",
    )
    return {"A": a, "B": b}


def test_inventory_lists_sources_in_order_and_hides_raw(spark, sources):
    found = dict(rows(harmonize.column_inventory(spark, sources)))
    assert found == {"date": ["A", "B"], "time": ["A"], "type": ["A", "B"], "beat": ["B"]}


def test_filled_inventory_counts_values_of_all_sources(sources):
    found = {r.column_name: (r.sources, r.non_null) for r in harmonize.filled_inventory(sources).collect()}
    assert found["date"] == (["A", "B"], 3)
    assert found["time"] == (["A"], 2)
    assert "raw_row_number" not in found


def test_union_keeps_shared_columns_and_duplicates(sources):
    merged = harmonize.merge_cities(sources, WANTED)
    assert merged.columns == ["date", "time", "type", "city"]
    assert rows(merged, "date") == [
        ("2014-01-01", "10:00:00", "vehicular", "A"),
        ("2014-01-01", "10:00:00", "vehicular", "A"),
        ("2014-01-02", None, "pedestrian", "B"),
    ]


def test_shared_raw_columns_survive(spark):
    a = spark.createDataFrame([("1", "x", "2")], "raw_row_number string, raw_a string, date string")
    merged = harmonize.merge_cities({"A": a, "B": a}, ["date"])
    assert merged.columns == ["raw_a", "date", "city"]


def test_null_tokens_and_saved_index(spark, tmp_path):
    path = tmp_path / "stops.csv"
    path.write_text(
        '\ufeff,date,time,subject_sex,note\n0,2014-01-01,N/A,male,"a, ""quoted"" word"\n'
        '1,NA,"",NaN, N/A\n2,2014-01-03,09:00:00,,None\n'
    )
    table = read_text_table(spark, str(path))
    assert table.columns == ["date", "time", "subject_sex", "note"]
    assert rows(table) == [
        ("2014-01-01", None, "male", 'a, "quoted" word'),
        (None, None, None, " N/A"),
        ("2014-01-03", "09:00:00", None, None),
    ]


def test_drop_index_only_looks_at_the_first_column(spark):
    df = spark.createDataFrame([(1, 2)], "a int, X1 int")
    assert drop_index(df).columns == ["a", "X1"]
    assert drop_index(df.select("X1", "a")).columns == ["a"]


def test_merge_job_writes_typed_partitions(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "raw_row_number,date,time,subject_age,subject_race,type,lat\n"
        "1,2014-05-01,18:31:59,33,white,vehicular,37.5\n2,2015-05-01,,NA,black,vehicular,\n"
    )
    (tmp_path / "b.csv").write_text(
        "raw_row_number,beat,date,subject_race,type\n1,9,2014-07-01,hispanic,pedestrian\n"
    )
    out = str(tmp_path / "merged")
    merge_stops(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")}, out)
    merged = read_table(spark, out)
    kinds = dict(merged.dtypes)
    assert kinds["date"] == "date" and kinds["second_of_day"] == "int" and kinds["lat"] == "double"
    found = rows(merged.select("city", "year", "second_of_day", "subject_age", "lat"), "city", "year")
    assert found == [
        ("A", 2014, 66719, 33.0, 37.5),
        ("A", 2015, None, None, None),
        ("B", 2014, None, None, None),
    ]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'c "d" e', None)], "x string, y string, z string")
    write_table(df, str(tmp_path / "t"), file_format="csv")
    assert rows(read_text_table(spark, str(tmp_path / "t"))) == [("a,b", 'c "d" e', None)]
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "u"), file_format="xml")


def test_reading_cities_keeps_their_own_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,type\n2014-01-01,vehicular\n")
    (tmp_path / "b.csv").write_text("beat,date\n3,2014-01-01\n")
    tables = read_cities(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")})
    assert {city: df.columns for city, df in tables.items()} == {
        "A": ["date", "type"],
        "B": ["beat", "date"],
    }


def test_files_of_one_city_must_share_a_header(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("date,type\n2014-01-01,vehicular\n")
    (tmp_path / "c" / "b.csv").write_text("type,date\nvehicular,2014-01-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_text_table(spark, str(tmp_path / "c")).collect()


def test_counting_and_pruning_pass_the_header_check(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in "ab":
        (tmp_path / "d" / f"{name}.csv").write_text("date,type,beat\n2014-01-01,vehicular,3\n")
    table = read_text_table(spark, str(tmp_path / "d"))
    assert table.count() == 2
    assert rows(table.select("beat")) == [("3",), ("3",)]
    assert rows(table.select("beat", "date")) == [("3", "2014-01-01")] * 2


def test_malformed_rows_stop_the_job_or_are_told(spark, tmp_path):
    good = "date,type,beat\n2014-01-01,vehicular,3\n"
    for name, bad in {"more": "2014-01-02,vehicular,3,4", "fewer": "2014-01-02,vehicular", "broken": '2014-01-02,"a\nb",3'}.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(good + bad + "\n")
        for wanted in (["date", "type", "beat"], ["date"]):
            with pytest.raises(Exception, match="malformed row"):
                read_text_table(spark, str(path)).select(wanted).collect()
        kept = read_text_table(spark, str(path), strict=False)
        told = kept.where(F.col(MALFORMED).isNotNull()).select("date", MALFORMED).collect()
        assert told[0][1].startswith("2014-01-02")
    assert read_text_table(spark, str(tmp_path / "broken.csv"), multi_line=True).count() == 2
