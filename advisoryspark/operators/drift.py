"""Drift between model versions, from mergeable sketches of their logged predictions.

Each write of predictions appends one row for its version and day: the number of values
and a KLL quantile sketch of them (K = 4096, rank error about 0.13 %; exact up to K
values).  Sketches merge, so comparing two versions over any days reads these rows and
no prediction.  Both distributions are compared at the GRID quantiles of each: the
greatest distance of the distribution functions (KS) to within 1 / GRID and twice the
sketch's error, and the population stability index over BINS bins of equal share of
the reference.  An empty bin counts as half a grid step.

Defined cases: null predictions are left out and counted apart; a version without
values has no drift row.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

K, GRID, BINS = 4096, 256, 16
SCHEMA = "model_version string, day date, n bigint, n_null bigint, sketch binary"


def log_sketch(scored: DataFrame, path: str, model_version: str, value: str, day: Column | None = None) -> None:
    """Append one row for each day of a batch of predictions: today by default."""
    rows = scored.select((F.current_date() if day is None else day).alias("day"), F.col(value).cast("double").alias("x"))
    sketched = rows.groupBy("day").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"),
        F.kll_sketch_agg_double("x", F.lit(K)).alias("sketch"))
    sketched.select(F.lit(model_version).alias("model_version"), "day", "n", "n_null", "sketch").write.mode("append").parquet(path)


def merged(spark: SparkSession, path: str, per_day: bool = False) -> DataFrame:
    """One row for each version (and day): n, n_null and the GRID + 1 quantiles."""
    keys = ["model_version", "day"] if per_day else ["model_version"]
    whole = spark.read.schema(SCHEMA).parquet(path).filter("n > 0").groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"),
        F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"))
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return whole.withColumn("q", F.kll_sketch_get_quantile_double("sketch", ranks)).drop("sketch")


def _held(quantiles: Column, x: Column) -> Column:
    """Grid points of a distribution up to x, the smallest value not counted twice."""
    return F.size(F.filter(F.slice(quantiles, 2, GRID), lambda v: v <= x))


def _stability(reference: Column, current: Column) -> Column:
    """Sum over the bins of (p - q) ln(p / q)."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda k: F.when(k == 0, F.lit(float("-inf"))).when(
        k == BINS, F.lit(float("inf"))).otherwise(F.get(reference, (k * (GRID // BINS)).cast("int"))))

    def share(quantiles: Column, k: Column) -> Column:
        n = _held(quantiles, F.get(cuts, k + 1)) - _held(quantiles, F.get(cuts, k))
        return F.greatest(n / F.lit(float(GRID)), F.lit(0.5 / GRID))

    parts = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: (
        share(reference, k) - share(current, k)) * F.log(share(reference, k) / share(current, k)))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def compare(spark: SparkSession, path: str, reference: str, per_day: bool = False) -> DataFrame:
    """Every version (and day) against all of the reference version: n, n_null, n_reference, ks, psi."""
    base = merged(spark, path).filter(F.col("model_version") == reference)  # one row
    both = merged(spark, path, per_day).withColumns({
        "n_reference": base.select("n").scalar(), "r": base.select("q").scalar()}).filter("r IS NOT NULL")
    apart = F.array_max(F.transform(F.concat("q", "r"), lambda x: F.abs(
        _held(F.col("q"), x) - _held(F.col("r"), x)))) / F.lit(float(GRID))
    keys = ["model_version", "day"] if per_day else ["model_version"]
    return both.select(*keys, "n", "n_null", "n_reference", apart.alias("ks"),
                       _stability(F.col("r"), F.col("q")).alias("psi"))
