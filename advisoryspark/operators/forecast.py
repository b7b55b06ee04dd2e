"""Trends and ARIMA forecasts of counted series.

A series is (series, t, n): one row per period, already counted, so its length
is bounded by the calendar and not by the data.  Every function handles all
series at once; one series is simply one group.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from advisoryspark.functions.scores import numpy_round

MIN_POINTS = 3
_BISECTIONS = 60


def yearly_counts(records: DataFrame, by: str | None = None) -> DataFrame:
    """Records per year, for the whole table or per value of `by`; years that are no number are left out."""
    series = F.lit("all") if by is None else F.col(by)
    return (
        records.select(series.alias("series"), F.col("Year").try_cast("int").alias("t"))
        .filter("t IS NOT NULL")
        .groupBy("series", "t").agg(F.count(F.lit(1)).alias("n"))
    )


def fits(counts: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """One row per series with enough history: line, ordered points, last period, AR(1) terms.

    A single aggregation of the counts; every table below is read off these rows
    without joining the counts again.  A series' points are one row per day or
    year, so their array is bounded by the calendar; `t` must not be finer.
    """
    points = F.array_sort(F.collect_list(F.struct("t", "n")))
    lines = counts.groupBy("series").agg(
        F.regr_slope("n", "t").alias("slope"), F.regr_intercept("n", "t").alias("intercept"),
        points.alias("points"),
    ).filter(F.size("points") >= min_points)
    values = F.transform("points", lambda p: p["n"].cast("double"))
    steps = F.size("points") - 1
    diffs = F.zip_with(F.slice(values, 2, steps), F.slice(values, 1, steps), lambda a, b: a - b)
    last = F.element_at("points", -1)
    rows = lines.withColumns({
        "last_t": last["t"], "last_n": last["n"].cast("double"), "z": diffs,
    })
    return rows.withColumns({"last_diff": F.get("z", F.size("z") - 1), "phi": ar1_coefficient(F.col("z"))}).drop("z")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)


def ar1_coefficient(z: Column) -> Column:
    """AR(1) coefficient of an array of differences, by exact likelihood.

    The likelihood equation of a zero-mean AR(1) is a cubic in the coefficient
    with one root in (-1, 1); bisection inside an array fold finds it, so the
    whole fit is a native expression.  Null for constant or too short series.
    """
    n = F.size(z)
    squares = F.transform(z, lambda x: x * x)
    before, after = F.slice(z, 1, n - 1), F.slice(z, 2, n - 1)
    sums = F.struct(
        n.cast("double").alias("m"),
        _sum(squares).alias("c"),
        _sum(F.zip_with(before, after, lambda a, b: a * b)).alias("b"),
        (_sum(squares) - F.get(squares, F.lit(0)) - F.get(squares, n - 1)).alias("d"),
    )

    def halve(state: Column, _step: Column) -> Column:
        s, x = state["s"], (state["lo"] + state["hi"]) / 2
        slope = ((((1 - s["m"]) * s["d"] * x + (s["m"] - 2) * s["b"]) * x
                  + (s["c"] + s["m"] * s["d"])) * x - s["m"] * s["b"])
        return F.struct(F.when(slope < 0, x).otherwise(state["lo"]).alias("lo"),
                        F.when(slope < 0, state["hi"]).otherwise(x).alias("hi"), s.alias("s"))

    start = F.struct(F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"), sums.alias("s"))
    root = F.aggregate(
        F.sequence(F.lit(1), F.lit(_BISECTIONS)), start, halve,
        lambda state: F.when(state["s"]["c"] > 0, (state["lo"] + state["hi"]) / 2))
    return F.when(n >= 2, root)


def _line(t: Column) -> Column:
    return F.col("intercept") + F.col("slope") * t


def _history(fitted: DataFrame) -> DataFrame:
    return fitted.withColumn("p", F.explode("points")).withColumns({"t": F.col("p.t"), "actual": F.col("p.n")})


def _future(fitted: DataFrame, steps: int) -> DataFrame:
    """One row per series and coming period."""
    return fitted.drop("points").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn(
        "t", F.col("last_t") + F.col("step"))


def _arima110() -> Column:
    """Forecast at `step`: the last difference carried on, or the line where that has no solution."""
    carried = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0.0),
                          lambda total, k: total + F.pow(F.col("phi"), k.cast("double")))
    return F.rint(F.coalesce(F.col("last_n") + F.col("last_diff") * carried, _line(F.col("t"))))


def linear_trend(counts: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """History with its fitted line: series, t, actual, linear_trend."""
    return _history(fits(counts, min_points)).select(
        "series", "t", "actual", numpy_round(_line(F.col("t")), 1).alias("linear_trend"))


def linear_forecast(counts: DataFrame, steps: int = 2, min_points: int = MIN_POINTS) -> DataFrame:
    return _future(fits(counts, min_points), steps).select(
        "series", "t", numpy_round(_line(F.col("t")), 1).alias("linear_prediction"))


def arima110_forecast(counts: DataFrame, steps: int = 2, min_points: int = MIN_POINTS) -> DataFrame:
    """ARIMA(1,1,0) without constant, in whole numbers."""
    return _future(fits(counts, min_points), steps).select(
        "series", "t", "step", _arima110().alias("arima_prediction"))


def forecast_table(counts: DataFrame, steps: int = 2, min_points: int = MIN_POINTS) -> DataFrame:
    """series, t, linear_prediction, arima_prediction."""
    return _future(fits(counts, min_points), steps).select(
        "series", "t", numpy_round(_line(F.col("t")), 1).alias("linear_prediction"),
        _arima110().alias("arima_prediction"))


def display_series(counts: DataFrame, steps: int = 2, min_points: int = MIN_POINTS) -> DataFrame:
    """History and forecast under each other; the ARIMA line starts at the last actual value."""
    fitted = fits(counts, min_points)
    line = numpy_round(_line(F.col("t")), 1).alias("linear")
    history = _history(fitted).select(
        "series", "t", "actual", line,
        F.when(F.col("t") == F.col("last_t"), F.col("last_n")).alias("arima"))
    coming = _future(fitted, steps).select(
        "series", "t", F.lit(None).cast("bigint").alias("actual"), line, _arima110().alias("arima"))
    return history.unionByName(coming)


def _arma11_likelihood(z: np.ndarray, phi: np.ndarray, theta: np.ndarray):
    """Concentrated exact log likelihood and next-value forecast for arrays of parameters,
    by the innovations recursion of a zero-mean ARMA(1,1)."""
    r = (1 + 2 * theta * phi + theta ** 2) / (1 - phi ** 2)
    forecast, squares, logs = np.zeros_like(phi), np.zeros_like(phi), np.zeros_like(phi)
    for value in z:
        error = value - forecast
        squares += error ** 2 / r
        logs += np.log(r)
        forecast = phi * value + theta / r * error
        r = 1 + theta ** 2 - theta ** 2 / r
    return -0.5 * (len(z) * np.log(squares / len(z)) + logs), forecast


def arima111_forecast(counts: DataFrame, steps: int = 2, min_points: int = MIN_POINTS) -> DataFrame:
    """ARIMA(1,1,1) without constant, one small fit per series, all series in parallel.

    A group holds one counted series, a row per day or year; one of fewer than
    `min_points` rows gives none.  The likelihood is maximised on a grid over
    the open square that is narrowed around its best cell.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_points:
            return pd.DataFrame({"series": [], "t": [], "phi": [], "theta": [], "arima_prediction": []}).astype(
                {"series": "object", "t": "int32"})
        pdf = pdf.sort_values("t")
        y = pdf["n"].to_numpy(float)
        z = np.diff(y)
        ahead = np.arange(1, steps + 1)
        phi = theta = 0.0
        next_diff = 0.0
        if np.any(z != 0):
            half = 0.995
            for _ in range(9):
                side = np.linspace(-1, 1, 33) * half
                p, q = np.meshgrid(np.clip(phi + side, -0.999, 0.999), np.clip(theta + side, -0.999, 0.999))
                score, following = _arma11_likelihood(z, p.ravel(), q.ravel())
                best = int(np.argmax(score))
                phi, theta, next_diff = p.ravel()[best], q.ravel()[best], following[best]
                half /= 6
        path = y[-1] + next_diff * np.cumsum(phi ** (ahead - 1.0))
        return pd.DataFrame({"series": pdf["series"].iloc[0], "t": int(pdf["t"].iloc[-1]) + ahead,
                             "phi": phi, "theta": theta, "arima_prediction": path})

    return counts.groupBy("series").applyInPandas(
        fit, "series string, t int, phi double, theta double, arima_prediction double")
