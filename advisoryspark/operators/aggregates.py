"""Grouped counts, the status summary, pivots and histograms.

All of these are partial-then-final aggregates: a value that fills a third of
the table reaches the shuffle as one row per task.
"""

from pyspark.sql import DataFrame, Window, functions as F

SUMMARY_DIMENSIONS = {
    "severity": "True_Severity",
    "exploit": "Exploit_Type",
    "component": "Affected_Component",
    "year": "Year",
}


def kpis(records: DataFrame) -> DataFrame:
    """Total, average score and number of HIGH or CRITICAL records; zeros when empty."""
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.round(F.avg("CVSS_Score"), 2), F.lit(0.0)).alias("avg_cvss"),
        F.count_if(F.col("True_Severity").isin("HIGH", "CRITICAL")).alias("high_critical"),
    )


def count_by(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_counts(records: DataFrame, column: str, k: int = 10) -> DataFrame:
    """k most frequent values, ties by value."""
    return count_by(records, column).orderBy(F.desc("n"), column).limit(k)


def shares(records: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value."""
    counts = count_by(records, column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 1))


def summary(records: DataFrame, top_components: int = 10) -> DataFrame:
    """All status counts from one scan: dimension, key, n, avg_cvss.

    Grouping sets give the total and the four breakdowns in a single
    aggregate; only the largest components are kept.
    """
    columns = list(SUMMARY_DIMENSIONS.values())
    sets = [[]] + [[c] for c in columns]
    grouped = (
        records.groupingSets(sets, *columns)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("CVSS_Score").alias("avg_cvss"),
             F.grouping_id(*columns).alias("gid"))
    )
    # grouping_id has a zero bit for the grouped column, leftmost column highest.
    full = 2 ** len(columns) - 1
    dimension, key = F.lit("total"), F.lit("all")
    for i, (name, column) in enumerate(SUMMARY_DIMENSIONS.items()):
        here = F.col("gid") == full - 2 ** (len(columns) - 1 - i)
        dimension = F.when(here, name).otherwise(dimension)
        key = F.when(here, F.col(column)).otherwise(key)
    long = grouped.select(
        dimension.alias("dimension"), key.alias("key"), "n",
        F.when(F.col("gid") == full, F.coalesce(F.round("avg_cvss", 2), F.lit(0.0))).alias("avg_cvss"),
    )
    # Ranks the grouped rows, one per distinct value.
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "key"))
    return (
        long.withColumn("rank", rank)
        .filter((F.col("dimension") != "component") | (F.col("rank") <= top_components))
        .drop("rank")
    )


def status_report(records: DataFrame, metrics: DataFrame) -> DataFrame:
    """The summary with the rounded model metrics on each row."""
    def metric(name: str, digits: int, scale: float = 1.0):
        return F.round(metrics.select(name).scalar() * scale, digits)

    return summary(records).withColumns({
        "rf_mae": metric("rf_mae", 3),
        "rf_rmse": metric("rf_rmse", 3),
        "memm_accuracy": metric("memm_accuracy", 1, 100.0),
    })


def year_by_label(records: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Count per year with one column per label, zero where none."""
    pivot = records.groupBy("Year").pivot(column, labels).agg(F.count(F.lit(1)))
    return pivot.na.fill(0)


def score_bins(records: DataFrame) -> DataFrame:
    """Ten unit-wide score bins, 10.0 in the last, empty bins as zero."""
    index = F.floor(F.least(F.lit(9.9), F.col("CVSS_Score"))).cast("int")
    counts = records.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = records.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").na.fill(0, ["n"])


def histogram(records: DataFrame, column: str = "CVSS_Score", bins: int = 10) -> DataFrame:
    """Equal-width bins over min..max, the last one closed, with the overall mean."""
    spark = records.sparkSession
    values = records.select(F.col(column).alias("x")).filter("x IS NOT NULL")
    stats = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))
    flat = F.col("lo") == F.col("hi")
    stats = stats.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "mean")
    lo, hi = stats.select("lo").scalar(), stats.select("hi").scalar()
    width = F.col("w")
    edge = F.col("lo") + F.col("b") * width
    placed = (
        values.withColumn("lo", lo).withColumn("w", (hi - lo) / bins)
        .withColumn("b", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
        # The division may land a value one bin beside its edge; the edges decide.
        .withColumn("bin", F.when(F.col("x") < edge, F.col("b") - 1)
                    .when((F.col("b") < bins - 1) & (F.col("x") >= edge + width), F.col("b") + 1)
                    .otherwise(F.col("b")))
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = (
        spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        .withColumn("lo", lo).withColumn("w", (hi - lo) / bins)
        .select("bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("bin_start"),
                F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("bin_end"))
    )
    return (
        frame.join(counts, "bin", "left").na.fill(0, ["n"])
        .withColumn("mean", F.round(stats.select("mean").scalar(), 4))
    )
