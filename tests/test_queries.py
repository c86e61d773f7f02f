import pytest
from conftest import plan

import __spark_entry__ as entry
from checks.compare import connect, spark_rows, sql_rows
from checks.oracle import ORACLE
from checks.queries import QUERIES

# They write files or fit a model while the frame is built.
EAGER = {"csv_files", "rejected_rows", "replaced_city", "census_files", "indexed_file", "spline_basis"}
EAGER |= {name for name in QUERIES if name.startswith("model_")} - {"model_cells"}
# The parts of cities and light that are left need more stops than the smallest tables have.
MORE_ROWS = {"model_separated"}
FROM_CELLS = [
    "twilight_stages",
    "twilight_counts",
    "dark_share_slice",
    "dark_share_overall",
    "dark_share_total",
    "model_cells",
    "spline_knots",
]


def test_all_queries_are_registered_and_have_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).columns == ["city", "hour", "pct", "rank"]
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - MORE_ROWS))
def test_query_equals_sql(spark, connection, sf_dir, name):
    found = spark_rows(QUERIES[name](spark, sf_dir))
    assert found == sql_rows(connection, ORACLE[name])


@pytest.mark.parametrize("name", sorted(MORE_ROWS))
def test_query_equals_sql_on_more_rows(spark, name):
    larger = "/root/testdata/sf0.01"
    assert spark_rows(QUERIES[name](spark, larger)) == sql_rows(connect(larger), ORACLE[name])


def test_estimates_are_numbers_on_few_rows(spark, sf_dir):
    rows = QUERIES["model_base"](spark, sf_dir).collect()
    assert [row.term for row in rows] == ["intercept", "is_dark", *[f"minute_{i}" for i in range(1, 7)]]
    assert None not in {row.estimate for row in rows}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plans_stay_in_the_jvm(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct"):
        assert node not in text


@pytest.mark.parametrize("name", FROM_CELLS)
def test_twilight_tables_follow_from_cells(spark, sf_dir, name):
    """The stops are read once, for the cells; no plan behind them scans a table again."""
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Scan ExistingRDD" in text and "FileScan" not in text
