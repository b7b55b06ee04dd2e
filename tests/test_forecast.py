"""Forecast edge cases and independent likelihood checks."""

import numpy as np
import pytest

from advisoryspark.operators import forecast


def series(spark, **named):
    rows = [(name, 2017 + i, int(v)) for name, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, t int, n long")


def test_too_short_series_are_left_out(spark):
    counts = series(spark, two=[1, 2], three=[1, 2, 4])
    assert {r.series for r in forecast.forecast_table(counts).collect()} == {"three"}
    assert {r.series for r in forecast.linear_trend(counts).collect()} == {"three"}
    assert {r.series for r in forecast.linear_forecast(counts, min_points=2).collect()} == {"two", "three"}
    assert {r.series for r in forecast.arima111_forecast(counts).collect()} == {"three"}


def test_constant_and_steady_series(spark):
    counts = series(spark, flat=[5] * 6, steady=[10, 30, 50, 70, 90])
    rows = {(r.series, r.t): (r.linear_prediction, r.arima_prediction)
            for r in forecast.forecast_table(counts).collect()}
    assert rows[("flat", 2023)] == (5.0, 5.0) and rows[("flat", 2024)] == (5.0, 5.0)
    assert rows[("steady", 2022)] == (110.0, 110.0) and rows[("steady", 2023)] == (130.0, 130.0)


def test_coefficient_maximises_the_exact_likelihood(spark):
    rng = np.random.default_rng(9)
    named = {f"s{i}": np.cumsum(rng.integers(-20, 30, 14)) for i in range(8)}
    counts = series(spark, **named)
    got = {r.series: r.phi for r in forecast.fits(counts).collect()}
    grid = np.linspace(-0.9999, 0.9999, 20001)
    for name, values in named.items():
        score, _ = forecast._arma11_likelihood(np.diff(values).astype(float), grid, np.zeros_like(grid))
        assert got[name] == pytest.approx(grid[int(np.argmax(score))], abs=2e-4)


def test_arima111_beats_or_equals_arima110_in_likelihood(spark):
    rng = np.random.default_rng(4)
    values = np.cumsum(rng.integers(-20, 30, 25))
    counts = series(spark, s=values)
    row = forecast.arima111_forecast(counts).orderBy("t").first()
    z = np.diff(values).astype(float)
    phi = forecast.fits(counts).first().phi
    score, following = forecast._arma11_likelihood(z, np.array([row.phi, phi]), np.array([row.theta, 0.0]))
    assert score[0] >= score[1] - 1e-9
    assert row.arima_prediction == pytest.approx(values[-1] + following[0])


def test_arma_likelihood_equals_gaussian_density():
    """The innovations recursion against the dense covariance of an ARMA(1,1)."""
    phi, theta = 0.6, -0.3
    z = np.random.default_rng(2).normal(size=12)
    lags = np.abs(np.subtract.outer(np.arange(12), np.arange(12)))
    variance = (1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2)
    first = (1 + phi * theta) * (phi + theta) / (1 - phi ** 2)
    cov = np.where(lags == 0, variance, first * phi ** np.maximum(lags - 1, 0.0))
    s2 = z @ np.linalg.solve(cov, z) / 12
    dense = -0.5 * (12 * np.log(s2) + np.linalg.slogdet(cov)[1])
    assert forecast._arma11_likelihood(z, np.array([phi]), np.array([theta]))[0][0] == pytest.approx(dense)


def test_display_bridges_from_the_last_actual(spark):
    rows = {r.t: r for r in forecast.display_series(series(spark, s=[3, 9, 4, 8, 7])).collect()}
    assert [rows[t].actual for t in range(2017, 2024)] == [3, 9, 4, 8, 7, None, None]
    assert rows[2020].arima is None and rows[2021].arima == 7.0 and rows[2022].arima is not None


def test_unknown_years_are_left_out(spark):
    records = spark.createDataFrame([("2020", "a"), ("Unknown", "a"), ("2021", "b")], "Year string, Exploit_Type string")
    assert {(r.series, r.t, r.n) for r in forecast.yearly_counts(records).collect()} == {("all", 2020, 1), ("all", 2021, 1)}
