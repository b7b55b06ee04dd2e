"""Models retrained from statistics that follow the keyed table, without reading old texts.

What the models need of the records adds up: for each term the texts that hold it and
its occurrences, for each weakness the number and sum of scores, the records of each
year and exploit.  An epoch of the table adds the statistics of its new versions and
takes away those of the versions they replace; both come from the buckets the epoch
touched.  The log keeps one folder of such differences an epoch, and a model is fitted
from their sums, which equals a fit over the whole table.

Layout: <root>/epoch=N/statistic=NAME/ with rows (key, key2, n, total).  An epoch
applied again writes the same folder again.  `compact` replaces the folders up to an
epoch by their sums, so the log's length follows its distinct keys.
"""

import math
import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from advisoryspark.operators import tfidf
from advisoryspark.sources import keyed, placed

SCHEMA = "statistic string, key string, key2 string, n bigint, total decimal(38,6)"
_ADDED = ["key", "key2"]


def _statistics(records: DataFrame, sign: int) -> DataFrame:
    """Rows of all statistics, counting `sign`."""
    words = F.filter(F.split("Cleaned_Description", " "), lambda w: F.length(w) >= 2)
    none = F.lit(None).cast("string")
    parts = [
        records.select(F.explode(words).alias("key")).select(
            F.lit("occurrences").alias("statistic"), "key", none.alias("key2"), F.lit(sign).alias("n"), F.lit(0.0).alias("total")),
        records.select(F.explode(F.array_distinct(words)).alias("key")).select(
            F.lit("texts").alias("statistic"), "key", none.alias("key2"), F.lit(sign).alias("n"), F.lit(0.0).alias("total")),
        records.select(F.lit("scores").alias("statistic"), F.col("CWE").alias("key"), none.alias("key2"),
                       F.lit(sign).alias("n"), (F.col("CVSS_Score") * sign).alias("total")),
        records.select(F.lit("years").alias("statistic"), F.col("Year").alias("key"), F.col("Exploit_Type").alias("key2"),
                       F.lit(sign).alias("n"), F.lit(0.0).alias("total")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("total", F.col("total").cast("decimal(20,6)"))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("statistic", *_ADDED).agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total"))


def _folders(spark: SparkSession, root: str) -> dict[int, str]:
    """Finished folders by epoch; a compacted one stands for all epochs up to its own."""
    done = {}
    for path in placed.found(spark, f"{root}/*=*/_SUCCESS"):
        kind, epoch = re.search(r"/(epoch|upto)=(\d+)/_SUCCESS$", path).groups()
        done[kind, int(epoch)] = path.rsplit("/", 1)[0]
    base = max((e for kind, e in done if kind == "upto"), default=-1)
    kept = {e: path for (kind, e), path in done.items() if kind == "epoch" and e > base}
    return kept | ({base: done["upto", base]} if base >= 0 else {})


def refresh(spark: SparkSession, table_root: str, root: str) -> list[int]:
    """Log the differences of the finished epochs of the table that the statistics lack; returns them."""
    last = max(_folders(spark, root), default=-1)
    missing = sorted(e for e in keyed.batches(spark, table_root).values() if e > last)
    for epoch in missing:
        new, old = keyed.changes(spark, table_root, epoch)
        _write(_added(_statistics(new, 1).unionByName(_statistics(old, -1))).filter("n <> 0 OR total <> 0"),
               f"{root}/epoch={epoch}")
    return missing


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("statistic").parquet(path)


def read(spark: SparkSession, root: str, statistic: str) -> DataFrame:
    """The current value of one statistic: key, key2, n, total; keys that no record has any more are gone."""
    found = [f"{path}/statistic={statistic}" for path in _folders(spark, root).values()]
    found = [p for p in found if placed.found(spark, p)]
    schema = "key string, key2 string, n bigint, total decimal(38,6)"
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return (rows.groupBy(*_ADDED).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n <> 0"))


def compact(spark: SparkSession, root: str) -> None:
    """Write the sums of all folders as one."""
    folders = _folders(spark, root)
    if folders:
        rows = spark.createDataFrame([], SCHEMA)
        for path in folders.values():
            rows = rows.unionByName(spark.read.schema(SCHEMA).parquet(path))
        _write(_added(rows).filter("n <> 0 OR total <> 0"), f"{root}/upto={max(folders)}")


def vocabulary(spark: SparkSession, root: str, size: int = tfidf.MAX_FEATURES) -> DataFrame:
    """term, total, df of the most frequent terms, as `tfidf.vocabulary` counts them over all texts."""
    top = read(spark, root, "occurrences").select(F.col("key").alias("term"), F.col("n").alias("total"))
    top = top.orderBy(F.desc("total"), "term").limit(size)
    return top.join(read(spark, root, "texts").select(F.col("key").alias("term"), F.col("n").alias("df")), "term")


def records(spark: SparkSession, root: str) -> int:
    """Number of records."""
    return read(spark, root, "scores").agg(F.sum("n")).first()[0] or 0


def tfidf_model(spark: SparkSession, root: str, size: int = tfidf.MAX_FEATURES) -> PipelineModel:
    """The TF-IDF pipeline that `tfidf.fit` gives for the whole table; `size` terms come to the driver."""
    chosen = sorted(vocabulary(spark, root, size).collect(), key=lambda r: (-r["total"], r["term"]))
    n = records(spark, root)
    return tfidf.pipeline([r["term"] for r in chosen], [math.log((1 + n) / (1 + r["df"])) + 1 for r in chosen])


def mean_scores(spark: SparkSession, root: str) -> DataFrame:
    """Mean score of each weakness: CWE, n, mean."""
    return read(spark, root, "scores").select(F.col("key").alias("CWE"), "n",
                                              (F.col("total").cast("double") / F.col("n")).alias("mean"))


def yearly_counts(spark: SparkSession, root: str, by_exploit: bool = False) -> DataFrame:
    """The counted series that `forecast.yearly_counts` gives for the whole table."""
    series = F.col("key2") if by_exploit else F.lit("all")
    return (read(spark, root, "years").select(series.alias("series"), F.col("key").try_cast("int").alias("t"), "n")
            .filter("t IS NOT NULL").groupBy("series", "t").agg(F.sum("n").alias("n")))
