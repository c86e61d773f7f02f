"""Rows with line breaks inside quotes, read by many tasks, against the reader that takes a file as a whole."""

import csv
import random
from contextlib import contextmanager

import pytest
from conftest import rows

from duskline.sources.quoted import quoted_rows
from duskline.sources.readers import MALFORMED, SOURCE_FILE, city_columns, column_names, file_headers, read_cities, read_text_table


@contextmanager
def small_parts(spark, size):
    """Files are cut into parts of so many bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(path, table, end="\n"):
    with open(path, "w", newline="") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerows(table)
    return str(path)


def random_table(seed, n):
    rng = random.Random(seed)
    parts = ["a", 'say "x"', "\n", "b,c", " ", '""', "\n\n", "long " * 9, "é"]
    table = [["id", "note\nof two lines", "more"]]
    for i in range(n):
        table.append([str(i), "".join(rng.choices(parts, k=rng.randint(1, 6))), rng.choice(["x", "1\n2", "y,z"])])
    return table


def whole(spark, path):
    options = dict(header=True, multiLine=True, quote='"', escape='"')
    # It takes a line feed inside quotes for the kind of line end, and then leaves the other half of it.
    return [tuple(v and v.removesuffix("\r") for v in r) for r in spark.read.csv(path, **options).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [700, 1 << 20])
def test_rows_equal_those_of_the_whole_file_reader(spark, tmp_path, size, end):
    folder = tmp_path / "t"
    folder.mkdir()
    for seed in range(3):
        written(folder / f"{seed} part.csv", random_table(seed, 60), end)
    with small_parts(spark, size):
        table = read_text_table(spark, str(folder), multi_line=True)
        found = rows(table)
    assert table.columns == ["id", "note\nof two lines", "more"]
    expected = whole(spark, str(folder))
    assert len(expected) == 180
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    """The scan cuts the file although breaks lie in quotes; no task has all of it."""
    path = written(tmp_path / "t.csv", random_table(5, 1500))
    with small_parts(spark, 8192):
        found = quoted_rows(spark, [path], str(tmp_path / "lines"))
        assert found.count() == 1501
        ids = {r.text.split(",")[0] for r in found.where("row > 0").collect()}
    parts = spark.read.parquet(str(tmp_path / "lines")).groupBy("file", "start").count().collect()
    lines = [r["count"] for r in parts]
    assert len(lines) > 5 and max(lines) < sum(lines) / 5
    assert ids == {str(i) for i in range(1500)}
    assert found.agg({"row": "max"}).first()[0] == 1500


def test_blank_lines_are_no_rows_and_stay_inside_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('\n  \na,b\n\n1,"x\n\n  \ny"\n \n2,z\n\n')
    for size in (9, 1 << 20):
        with small_parts(spark, size):
            found = rows(read_text_table(spark, str(path), multi_line=True), "a")
        assert found == [("1", "x\n\n  \ny"), ("2", "z")]


def test_a_quote_that_is_never_closed_stops_the_job(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\n' + "2,y\n" * 2000)
    with pytest.raises(ValueError, match="row 1 .* 2001 lines"):
        read_text_table(spark, str(path), multi_line=True)


def test_malformed_rows_and_their_files_are_told(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text('a,b\n1,"p\nq"\n2\n"3\n",4,5\n')
    (tmp_path / "t" / "y.csv").write_text("a,b\n6,7\n")
    path = str(tmp_path / "t")
    for wanted in (["a", "b"], ["a"]):
        with pytest.raises(Exception, match="malformed row"):
            read_text_table(spark, path, multi_line=True).select(wanted).collect()
    kept = read_text_table(spark, path, multi_line=True, strict=False)
    assert sorted(r[0] for r in kept.where(f"{MALFORMED} is not null").select(MALFORMED).collect()) == ['"3\n",4,5', "2"]
    assert {r[0].rsplit("/")[-1] for r in kept.where("a = '6'").select(SOURCE_FILE).collect()} == {"y.csv"}


def test_other_headers_stop_the_job(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t" / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="header differs"):
        read_text_table(spark, str(tmp_path / "t"), multi_line=True).collect()


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    paths = {}
    for i in range(300):
        path = tmp_path / f"{i} of it.csv"
        path.write_text(f'raw_row_number,"c\n{i}",date\n' + "1,2,3\n" * 5)
        paths[f"city {i}"] = str(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        columns = city_columns(spark, paths)
        # The other one lists the files, as there are many.
        assert len(tracker.getJobIdsForGroup("headers")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert columns == {f"city {i}": ["raw_row_number", f"c\n{i}", "date"] for i in range(300)}


def test_headers_of_odd_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("")
    (tmp_path / "t" / "b.csv").write_text('\n\n,x,,"p,q",x\r\n1,2,3,4,5\r\n')
    assert file_headers(spark, {"t": str(tmp_path / "t")}) == {"t": [None, "x", None, "p,q", "x"]}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert column_names([None, "x", None, "p,q", "X"]) == ["_c0", "x1", "_c2", "p,q", "X4"]
    table = read_cities(spark, {"T": str(tmp_path / "t" / "b.csv")})["T"]
    assert table.columns == spark.read.csv(str(tmp_path / "t" / "b.csv"), header=True).columns[1:]
    assert rows(table) == [("2", "3", "4", "5")]
    with pytest.raises(ValueError, match="no header found for E"):
        file_headers(spark, {"E": str(tmp_path / "t" / "a.csv")})
