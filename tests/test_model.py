import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskline.functions import spline
from duskline.operators import model

# Published basis of the 15 heights 58 to 72 with five degrees of freedom.
HEIGHTS = {
    58: [0.0, 0.0, 0.0, 0.0, 0.0],
    59: [7.592323e-03, 0.0, -8.670223e-02, 2.601067e-01, -1.734045e-01],
    60: [6.073858e-02, 0.0, -1.503044e-01, 4.509132e-01, -3.006088e-01],
    61: [2.047498e-01, 6.073858e-05, -1.677834e-01, 5.033503e-01, -3.355669e-01],
}


def test_basis_equals_published_numbers():
    heights = np.arange(58, 73.0)
    inner = np.quantile(heights, [0.2, 0.4, 0.6, 0.8])
    knots = (np.array([58, *inner, 72]) - 58) / 14
    basis = spline.natural_basis((heights - 58) / 14, knots)
    for height, row in HEIGHTS.items():
        assert basis[height - 58] == pytest.approx(row, abs=5e-7)


def test_spark_columns_equal_the_basis(spark):
    inner, low, high = [1020.0, 1041.5, 1077.0, 1100.0, 1180.0], 1001.0, 1267.0
    minutes = spark.range(1001, 1268).withColumnRenamed("id", "minute")
    columns = spline.spline_columns(F.col("minute"), inner, low, high)
    found = np.array([list(r) for r in minutes.select("minute", *columns).orderBy("minute").collect()])
    knots = (np.array([low, *inner, high]) - low) / (high - low)
    expected = spline.natural_basis((found[:, 0] - low) / (high - low), knots)
    assert np.abs(found[:, 1:] - expected).max() < 1e-10


def newton(x, y):
    """Plain logistic regression on single rows: estimates, errors, deviance."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta))
        information = (x * (mu * (1 - mu))[:, None]).T @ x
        beta = beta + np.linalg.solve(information, x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ beta))
    deviance = -2 * np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(information))), deviance


@pytest.fixture(scope="module")
def stops():
    rng = np.random.default_rng(7)
    count = 3000
    city = rng.choice(["Oakland", "Bakersfield", "San Jose"], count, p=[0.6, 0.3, 0.1])
    minute = rng.integers(1020, 1260, count)
    dark = minute + rng.integers(-90, 90, count) > 1140
    logit = -0.4 + 0.3 * dark + 0.5 * (city == "San Jose") + 0.002 * (minute - 1140)
    black = rng.random(count) < 1 / (1 + np.exp(-logit))
    return city, minute, dark, black


@pytest.fixture(scope="module")
def data(spark, stops):
    rows = [(str(c), int(m), bool(d), bool(b)) for c, m, d, b in zip(*stops)]
    cells = (
        spark.createDataFrame(rows, "city string, minute int, is_dark boolean, is_black boolean")
        .groupBy("city", "minute", "is_dark", "is_black")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return model.dark_data(cells)


def test_knots_are_quantiles_of_the_rows(stops, data):
    assert data.knots == pytest.approx(np.quantile(stops[1], np.arange(1, 6) / 6))
    assert (data.low, data.high) == (stops[1].min(), stops[1].max())
    assert data.cities == ("Bakersfield", "Oakland", "San Jose")


@pytest.mark.parametrize("by_city", [False, True])
def test_fit_on_cells_equals_fit_on_rows(stops, data, by_city):
    city, minute, dark, black = stops
    knots = (np.array([data.low, *data.knots, data.high]) - data.low) / (data.high - data.low)
    basis = spline.natural_basis((minute - data.low) / (data.high - data.low), knots)
    cities = [city == c for c in data.cities[1:]] if by_city else []
    x = np.column_stack([np.ones(len(minute)), dark, basis, *cities]).astype(float)
    beta, error, deviance = newton(x, black.astype(float))

    fitted = model.fit_dark_model(data, by_city)
    table = fitted.coefficients.collect()
    assert [r.term for r in table[:3]] == ["intercept", "is_dark", "minute_1"]
    assert [r.estimate for r in table] == pytest.approx(beta, abs=1e-7)
    assert [r.std_error for r in table] == pytest.approx(error, abs=1e-7)
    assert [r.z for r in table] == pytest.approx(beta / error, abs=1e-6)
    assert all(0 <= r.p <= 1 for r in table)
    fit = fitted.fit.first()
    assert fit.deviance == pytest.approx(deviance, rel=1e-9)
    share = black.mean()
    null = -2 * len(black) * (share * np.log(share) + (1 - share) * np.log(1 - share))
    assert fit.null_deviance == pytest.approx(null, rel=1e-9)
    assert (fit.n_rows, fit.df_null, fit.df_residual) == (3000, 2999, 3000 - len(table))
    assert fit.aic == pytest.approx(deviance + 2 * len(table), rel=1e-9)
    dark_row = model.dark_estimate(fitted).first()
    assert dark_row.estimate == table[1].estimate and dark_row.std_error == table[1].std_error


CELLS = "city string, minute int, is_dark boolean, is_black boolean, n long"


def test_few_rows_are_fitted_too(spark):
    rows = [("A", 1000 + 13 * i % 97, i % 2 == 1, i % 3 == 0, 1) for i in range(40)]
    fitted = model.fit_dark_model(model.dark_data(spark.createDataFrame(rows, CELLS)))
    fit = fitted.fit.first()
    assert (fit.n_rows, fit.n_light, fit.n_dark, fit.converged) == (40, 20, 20, True)
    assert 0 < fit.iterations < model.MAX_ITERATIONS
    assert None not in {r.estimate for r in fitted.coefficients.collect()}


def test_one_race_or_no_row_gives_null_estimates(spark):
    rows = [("A", 1000 + i, i % 2 == 1, True, 1) for i in range(40)]
    for kept in (rows, []):
        fitted = model.fit_dark_model(model.dark_data(spark.createDataFrame(kept, CELLS)))
        assert {r.estimate for r in fitted.coefficients.collect()} == {None}
        assert fitted.fit.first().n_rows == len(kept)


def cell_rows(counts):
    """Cells of several minutes with so many Black and other drivers, by city and light."""
    return [
        (city, 1000 + 7 * i % 200, dark, black, n)
        for (city, dark), both in counts.items()
        for black, n in zip((True, False), both)
        for i in range(40)
        if n
    ]


def numbers(fitted):
    return {r.term: (r.estimate, r.std_error) for r in fitted.coefficients.collect() if r.status == "fitted"}


MIXED = {("A", False): (3, 5), ("A", True): (4, 3), ("C", False): (2, 7), ("C", True): (3, 6)}


@pytest.mark.parametrize("city", ["0", "B"])
def test_a_city_of_one_race_is_separated(spark, city):
    """Also where it would be the base. The others are as without that city."""
    one = {(city, False): (2, 0), (city, True): (9, 0)}
    data = model.dark_data(spark.createDataFrame(cell_rows(MIXED | one), CELLS))
    fitted = model.fit_dark_model(data, by_city=True)
    status = {r.term: r.status for r in fitted.coefficients.collect()}
    assert [t for t, s in status.items() if s != "fitted"] == [f"city_{city}"]
    assert status[f"city_{city}"] == "separated" and "city_A" not in status
    without = model.dark_data(spark.createDataFrame(cell_rows(MIXED), CELLS))
    assert without.knots == data.knots
    alone = model.fit_dark_model(without, by_city=True)
    expected = numbers(alone)
    assert numbers(fitted).keys() == expected.keys()
    for term, pair in numbers(fitted).items():
        assert pair == pytest.approx(expected[term], rel=1e-6)
    fit, less = fitted.fit.first(), alone.fit.first()
    assert fit.converged and fit.deviance == pytest.approx(less.deviance)
    assert fit.df_residual == fit.n_rows - len(status)
    shares = {r.fitted for r in model.fitted_cells(data, fitted).where(F.col("city") == city).collect()}
    assert shares == {1.0}
    assert model.fit_dark_model(data).fit.first().converged


def test_darkness_that_tells_the_races_apart_is_separated(spark):
    """Neither light nor city has one race only, but together they part the races."""
    counts = {("A", False): (3, 5), ("A", True): (4, 0), ("C", False): (0, 7), ("C", True): (3, 6)}
    data = model.dark_data(spark.createDataFrame(cell_rows(counts), CELLS))
    fitted = model.fit_dark_model(data, by_city=True)
    status = {r.term: r.status for r in fitted.coefficients.collect()}
    assert [t for t, s in status.items() if s != "fitted"] == ["is_dark"] and status["is_dark"] == "separated"
    rest = {key: n for key, n in counts.items() if all(n)}
    alone = numbers(model.fit_dark_model(model.dark_data(spark.createDataFrame(cell_rows(rest), CELLS)), by_city=True))
    # What is left of one city is light and of the other dark.
    alone["city_C"] = alone.pop("is_dark")
    for term, pair in numbers(fitted).items():
        assert pair == pytest.approx(alone[term], rel=1e-6)
    shares = {(r.city, r.is_dark): r.fitted for r in model.fitted_cells(data, fitted).collect()}
    assert shares[("A", True)] == 1.0 and shares[("C", False)] == 0.0
    assert model.fit_dark_model(data).fit.first().converged


def test_all_parted_leaves_no_rows(spark):
    counts = {("A", False): (3, 0), ("A", True): (4, 0), ("C", False): (0, 7), ("C", True): (0, 6)}
    data = model.dark_data(spark.createDataFrame(cell_rows(counts), CELLS))
    fitted = model.fit_dark_model(data, by_city=True)
    status = {r.term: r.status for r in fitted.coefficients.collect()}
    assert status["city_C"] == "separated" and status["intercept"] == "no rows"


def test_parted_cells_equal_a_search_over_all_directions():
    """Every direction on a grid that lowers no Black cell, raises no other and moves no mixed one."""
    rng = random.Random(2)
    kinds = [(0, 0), (2, 0), (0, 2), (1, 3)]
    grid = [x / 2 for x in range(-4, 5)]
    for _ in range(400):
        cities = [None] if rng.random() < 0.2 else ["A", "B", "C"][: rng.randint(1, 3)]
        counts = {(city, dark): rng.choice(kinds) for city in cities for dark in (False, True)}
        moved = set()
        for step in (-1, 0, 1):
            ways = []
            for city in cities:
                fine = []
                for u in grid:
                    at = {(city, False): u, (city, True): u + step}
                    if all(
                        not any(n) or v == 0 or (v > 0 and not n[1]) or (v < 0 and not n[0])
                        for n, v in ((counts[key], v) for key, v in at.items())
                    ):
                        fine.append({key for key, v in at.items() if v and any(counts[key])})
                ways.append(fine)
            if all(ways):
                moved |= {key for fine in ways for way in fine for key in way}
        parted, gone, dark = model.parted_cells(counts)
        assert set(parted) == moved, counts
        left = {key for key, n in counts.items() if any(n)} - moved
        assert gone == {city for city, _ in moved} - {city for city, _ in left}
        if not dark:
            assert all(black == bool(counts[key][0]) for key, black in parted.items())


def test_a_term_that_depends_on_others_is_left_out(spark):
    """City B has the light stops and city A the dark ones: the city adds nothing."""
    rows = [
        ("A" if i % 2 else "B", 1000 + i * 7 % 200, i % 2 == 1, i % 5 < 2, 1) for i in range(1000)
    ]
    cells = spark.createDataFrame(
        rows, "city string, minute int, is_dark boolean, is_black boolean, n long"
    )
    data = model.dark_data(cells)
    plain, by_city = (model.fit_dark_model(data, flag) for flag in (False, True))
    expected = {r.term: tuple(r)[1:5] for r in plain.coefficients.collect()}
    found = {r.term: tuple(r)[1:] for r in by_city.coefficients.collect()}
    assert found.pop("city_B") == (None,) * 4 + ("dependent",)
    found = {term: row[:4] for term, row in found.items()}
    assert found.keys() == expected.keys()
    for term, numbers in found.items():
        assert numbers == pytest.approx(expected[term], rel=1e-6)
    assert by_city.fit.first().df_residual == plain.fit.first().df_residual == 1000 - 8


def test_no_rows_give_null_estimates(spark):
    empty = spark.createDataFrame(
        [], "city string, minute int, is_dark boolean, is_black boolean, n long"
    )
    fitted = model.fit_dark_model(model.dark_data(empty), by_city=True)
    assert [tuple(r)[1:] for r in fitted.coefficients.collect()] == [(None,) * 4 + ("no rows",)] * 2


def test_repeated_knots_lower_the_degrees_of_freedom(spark):
    rng = np.random.default_rng(3)
    rows = [
        ("A", int(m), bool(rng.random() < 0.5), bool(rng.random() < 0.4), 1)
        for m in [1100] * 500 + [1050] * 150 + [1150] * 150 + list(rng.integers(1000, 1200, 200))
    ]
    cells = spark.createDataFrame(
        rows, "city string, minute int, is_dark boolean, is_black boolean, n long"
    )
    data = model.dark_data(cells)
    assert len(data.knots) < 5
    fit = model.fit_dark_model(data).fit.first()
    assert fit.spline_df == len(data.knots) + 1 and fit.deviance > 0


def test_fit_does_not_return_to_the_stops(data):
    lineage = data.cells._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in lineage and "Exchange" not in lineage
