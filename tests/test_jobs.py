"""The jobs from files to result tables, for both studies."""

import random

import pytest
from conftest import plan, rows

from duskline.operators import clean, filters
from duskline.plans import jobs
from duskline.plans.study import STUDY_2014, STUDY_2017
from duskline.sources.readers import read_table
from duskline.sources.writers import write_table

CITIES = ["Bakersfield", "Los Angeles", "Oakland", "San Diego", "San Jose", "Santa Ana"]
HEADINGS = [f'"{city} city, California","Value Note for {city} city, California"' for city in CITIES[:5]]
FACTS = [
    ('"Population, Census, April 1, 2010"', '"300,000"'),
    ('"Female persons, percent"', "50.1%"),
    ('"Black or African American alone, percent"', "10.5%"),
    ('"Hispanic or Latino, percent"', "30.0%"),
    ('"White alone, not Hispanic or Latino, percent"', "40.0%"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    rng = random.Random(11)
    for number, city in enumerate(CITIES):
        columns = ["raw_row_number", "date", "time", "subject_age", "subject_race", "type"]
        if number % 2:
            columns += ["subject_sex", "beat"]
        lines = [",".join(columns)]
        # One city holds a third of all rows.
        for i in range(4000 if city == "Los Angeles" else 1600):
            time = f"{rng.choice([9, 17, 18, 18, 19, 19, 20]):02}:{rng.randrange(60):02}:00"
            values = {
                "raw_row_number": str(i),
                "date": f"{rng.choice([2014, 2017])}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
                "time": rng.choice([time] * 19 + ["NA"]),
                "subject_age": rng.choice(["NA", str(rng.randint(16, 80))]),
                "subject_race": rng.choice(["white", "black", "hispanic", "other", "NA"]),
                "type": rng.choice(["vehicular", "vehicular", "pedestrian"]),
                "subject_sex": rng.choice(["male", "female", ""]),
                "beat": "7",
            }
            lines.append(",".join(values[c] for c in columns))
        (folder / f"{number}.csv").write_text("\n".join(lines) + "\n")
    for name, headings in (("first", HEADINGS[3:]), ("second", HEADINGS[:3])):
        lines = [",".join(["Fact", "Fact Note", *headings])]
        lines += [",".join([fact, "", *[f"{value},"] * len(headings)]) for fact, value in FACTS]
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")

    paths = {city: str(folder / f"{number}.csv") for number, city in enumerate(CITIES)}
    jobs.merge_stops(spark, paths, f"{folder}/merged")
    jobs.census_table(spark, f"{folder}/first.csv", f"{folder}/second.csv", f"{folder}/census")
    for name, study in (("2014", STUDY_2014), ("2017", STUDY_2017)):
        jobs.run_study(spark, f"{folder}/merged", f"{folder}/census", f"{folder}/{name}", study)
    return folder


def table(spark, folder, name):
    return read_table(spark, f"{folder}/{name}")


def test_overview_counts_every_stage(spark, folder):
    stages = {r.stage: r.rows for r in table(spark, folder, "2014/overview/stage_counts").collect()}
    assert stages["read"] == 4000 + 5 * 1600
    clean = table(spark, folder, "2014/rates/clean_stops")
    assert stages["listed races"] == clean.count()
    assert stages["vehicular"] == filters.of_type(clean).count()
    counts = {
        (r.stage, r.column_name): r.non_null
        for r in table(spark, folder, "2014/overview/stage_completeness").collect()
    }
    assert counts[("complete", "subject_race")] == counts[("complete", "city")] == stages["complete"]
    assert counts[("listed races", "time")] == clean.where("time is not null").count()


def test_exported_csv_has_labels(spark, folder):
    jobs.export_csv(spark, f"{folder}/2014/rates/clean_stops", f"{folder}/csv")
    back = spark.read.csv(f"{folder}/csv", header=True)
    clean = table(spark, folder, "2014/rates/clean_stops")
    assert back.count() == clean.count()
    assert back.where("time = 'N/A'").count() == clean.where("time is null").count() > 0
    assert "second_of_day" not in back.columns


def test_inventory_of_files(spark, folder):
    paths = {city: str(folder / f"{number}.csv") for number, city in enumerate(CITIES)}
    jobs.inventory_table(spark, paths, f"{folder}/inventory")
    found = dict(rows(table(spark, folder, "inventory")))
    assert found["beat"] == CITIES[1::2] and found["date"] == CITIES
    assert "raw_row_number" not in found


def test_rebalanced_write_keeps_all_rows(spark, folder):
    merged = table(spark, folder, "merged")
    write_table(merged, f"{folder}/even", ["city", "year"], rebalance=True)
    back = table(spark, folder, "even").select(merged.columns)
    assert back.exceptAll(merged).isEmpty() and merged.exceptAll(back).isEmpty()


def test_merged_table_keeps_all_rows(spark, folder):
    assert table(spark, folder, "merged").count() == 4000 + 5 * 1600


@pytest.mark.parametrize(
    "year, cities",
    [
        ("2014", CITIES[:5]),
        ("2017", ["Bakersfield", "Los Angeles", "Oakland", "San Jose"]),
    ],
)
def test_study_tables(spark, folder, year, cities):
    profile = f"{year}/profile"
    counts = dict(rows(table(spark, folder, f"{profile}/city_counts"), "city"))
    assert list(counts) == cities
    assert counts["Los Angeles"] > counts["Oakland"]
    spans = rows(table(spark, folder, f"{profile}/date_span"))
    assert all(str(s[1])[:4] == str(s[2])[:4] == year for s in spans)
    bins = table(spark, folder, f"{profile}/date_histogram").collect()
    assert len(bins) == 10 and sum(r.n for r in bins) == sum(counts.values())
    assert len(table(spark, folder, f"{profile}/age_histogram").collect()) == 20

    clean = table(spark, folder, f"{year}/rates/clean_stops")
    vehicular = dict(rows(table(spark, folder, f"{year}/rates/vehicular_counts")))
    assert sum(vehicular.values()) == filters.of_type(clean).count()
    shares = table(spark, folder, f"{year}/rates/vehicular_race_share").collect()
    assert sum(r.share for r in shares) == pytest.approx(1)

    heads = table(spark, folder, f"{year}/rates/per_capita").collect()
    assert sum(r.black + r.hispanic + r.white for r in heads) == clean.count()
    assert [r.city for r in sorted(heads, key=lambda r: r.city)] == cities
    assert all(r.black_per_cap == pytest.approx(r.black / 31500) for r in heads)
    for row in table(spark, folder, f"{year}/rates/rate_interval").collect():
        assert row.lower_bound < row.difference < row.upper_bound

    solar = table(spark, folder, f"{year}/rates/solar_table")
    kept = table(spark, folder, f"{year}/rates/twilight_stops")
    stops = table(spark, folder, f"{year}/rates/clean_stops")
    days = filters.of_type(stops).select("city", "date").distinct()
    assert solar.count() == days.count() <= len(cities) * 365
    assert 200 < kept.count() < filters.of_type(stops).count()
    by_city = dict(rows(table(spark, folder, f"{year}/rates/twilight_counts")))
    assert sum(by_city.values()) == kept.count()
    terms = [r.term for r in table(spark, folder, f"{year}/rates/model_city").collect()]
    assert sorted(t for t in terms if t.startswith("city_")) == [f"city_{c}" for c in cities[1:]]
    fit = table(spark, folder, f"{year}/rates/model_city_fit").first()
    assert fit.n_rows == kept.count()


def test_a_study_reads_only_its_year(spark, folder):
    stops = jobs.study_stops(table(spark, folder, "merged"), STUDY_2014)
    text = stops.select("city", "type")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "PartitionFilters" in scan and "year" in scan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(date,2014-01-01)" in scan
    assert "IsNotNull(subject_race)" in scan
    assert "second_of_day" not in scan.split("ReadSchema")[1]


def test_no_shuffle_of_stops_before_the_twilight_filter(spark, folder):
    from duskline.operators import twilight

    stops = table(spark, folder, "2014/rates/clean_stops")
    days = table(spark, folder, "2014/rates/solar_table")
    text = plan(twilight.twilight_stops(stops, days))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


HEAD = "raw_row_number,date,time,subject_age,subject_race,type,lat,lng"


def city_file(path, lines, head=HEAD):
    path.write_text("\n".join([head, *lines]) + "\n")
    return str(path)


def years(*numbers, city="A"):
    return [f"{i},{year}-05-0{i % 9 + 1},18:0{i % 9}:00,3{i % 9},white,vehicular,1.5,2.5" for i, year in enumerate(numbers)]


def names(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet") if "_manifest" not in p.parts}


def test_one_city_and_year_are_replaced(spark, tmp_path):
    out = tmp_path / "merged"
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    paths = {"A": city_file(a, years(2014, 2014, 2015)), "B C": city_file(b, years(2014, 2016))}
    assert jobs.merge_stops(spark, paths, str(out)) == ["A", "B C"]
    before = names(out)
    assert jobs.merge_stops(spark, paths, str(out)) == []
    assert names(out) == before

    # The city has no stop of 2015 any more, one of 2017, and a column the table does not have.
    city_file(a, [row + ",7" for row in years(2014, 2017)], HEAD + ",beat")
    assert jobs.merge_stops(spark, paths, str(out)) == ["A"]
    after = names(out)
    others = {name for name in before if not name.startswith("city=A/")}
    assert others and all(after[name] == before[name] for name in others)
    found = rows(read_table(spark, str(out)).groupBy("city", "year").count(), "city", "year")
    assert found == [("A", 2014, 1), ("A", 2017, 1), ("B C", 2014, 1), ("B C", 2016, 1)]
    assert "beat" not in read_table(spark, str(out)).columns


def test_a_half_finished_run_is_done_again(spark, tmp_path):
    out = tmp_path / "merged"
    paths = {"A": city_file(tmp_path / "a.csv", years(2014, 2015)), "B": city_file(tmp_path / "b.csv", years(2014))}
    jobs.merge_stops(spark, paths, str(out))
    before = names(out)
    lost = next((out / "city=A" / "year=2015").glob("*.parquet"))
    lost.unlink()
    assert jobs.merge_stops(spark, paths, str(out)) == ["A"]
    assert read_table(spark, str(out)).count() == 3
    assert {n: t for n, t in names(out).items() if "city=B" in n} == {n: t for n, t in before.items() if "city=B" in n}


BAD = [
    "90,2014-02-30,18:00:00,30,white,vehicular,1,2",
    "91,2014-02-03,25:99:00,thirty,white,vehicular,1,2",
    "92,2014-02-03,18:00:00,30,white,vehicular,north,2",
    "93,2014-02-03,18:00:00,30,white,vehicular,1,2,3",
    "NA",
]


def test_rows_that_cannot_be_read_are_set_apart(spark, tmp_path):
    paths = {"A": city_file(tmp_path / "a.csv", years(*[2014] * 20) + BAD), "B": city_file(tmp_path / "b.csv", years(2014))}
    out, rejects = str(tmp_path / "merged"), str(tmp_path / "rejects")
    with pytest.raises(ValueError, match="5 of 26 rows cannot be read"):
        jobs.merge_stops(spark, paths, out, rejects=rejects)
    assert not (tmp_path / "merged").exists()
    assert jobs.merge_stops(spark, paths, out, rejects=rejects, most_rejected=0.2) == ["A", "B"]
    merged = read_table(spark, out)
    assert merged.count() == 21 and merged.where("second_of_day is null").count() == 0
    found = read_table(spark, rejects).collect()
    told = {r.row_text: (r.city, r.file.rsplit("/")[-1], r.reasons) for r in found}
    assert told == {
        "2014-02-30,18:00:00,30,white,vehicular,1,2,,,,": ("A", "a.csv", ["date"]),
        "2014-02-03,25:99:00,thirty,white,vehicular,1,2,,,,": ("A", "a.csv", ["time", "subject_age"]),
        "2014-02-03,18:00:00,30,white,vehicular,north,2,,,,": ("A", "a.csv", ["lat"]),
        BAD[3]: ("A", "a.csv", ["fields"]),
        BAD[4]: ("A", "a.csv", ["fields"]),
    }
    city_file(tmp_path / "a.csv", years(*[2014] * 20))
    assert jobs.merge_stops(spark, paths, out, rejects=rejects) == ["A"]
    assert names(tmp_path / "rejects") == {}


@pytest.mark.parametrize("bad", BAD)
def test_without_rejects_a_bad_row_stops_the_job(spark, tmp_path, bad):
    paths = {"A": city_file(tmp_path / "a.csv", years(2014) + [bad])}
    with pytest.raises(Exception, match="not a|malformed"):
        jobs.merge_stops(spark, paths, str(tmp_path / "merged"))
    assert not (tmp_path / "merged").exists()


def test_the_twilight_job_scans_the_clean_stops_once(spark, folder, monkeypatch, tmp_path):
    scans = []
    write = jobs.write_table

    def watched(df, path, *args, **options):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        places = [f.rsplit("/rates/")[-1].split("/")[0] for f in df.inputFiles()]
        scans.append((path.rsplit("/")[-1], plan.count("Relation"), "clean_stops" in places))
        return write(df, path, *args, **options)

    monkeypatch.setattr(jobs, "write_table", watched)
    jobs.twilight_study(spark, f"{folder}/2014/rates", STUDY_2014)
    assert [name for name, _, stops in scans if stops] == ["evening_stops"]
    # The stops and the solar table, which is read for the dusk of a day and its bounds.
    assert next(relations for name, relations, _ in scans if name == "evening_stops") == 3
