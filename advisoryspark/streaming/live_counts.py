"""Status counts that follow updates of the keyed table, without counting it again.

An epoch of the table that turns a record from HIGH to LOW takes one from one count
and adds one to the other: its new versions count plus one, the versions they replace
minus one, and the sum is added to the counts before.  Both sides come from the
buckets the epoch touched, in five narrow columns.  Counts are kept in a table,
<root>/epoch=N/ with a row for each value that occurs, so a reader opens one small
folder, and an epoch applied again writes the same folder again.  Scores are summed
as decimals, so what is added and taken away again leaves nothing behind.
"""

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from advisoryspark.operators.aggregates import SUMMARY_DIMENSIONS
from advisoryspark.sources import keyed, placed

COUNTS = "dimension string, key string, n bigint, score_sum decimal(38,6)"
_NARROW = (*SUMMARY_DIMENSIONS.values(), "CVSS_Score")


def _signed(records: DataFrame, sign: int) -> DataFrame:
    """A row for each record and dimension, counting `sign`."""
    cells = [F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("key"))]
    cells += [F.struct(F.lit(name).alias("dimension"), F.col(column).alias("key"))
              for name, column in SUMMARY_DIMENSIONS.items()]
    score = (F.col("CVSS_Score") * sign).cast("decimal(20,6)")
    return records.select(*_NARROW).select(F.explode(F.array(*cells)).alias("cell"), F.lit(sign).alias("n"),
                                           score.alias("score_sum")).select("cell.*", "n", "score_sum")


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("dimension", "key").agg(
        F.sum("n").alias("n"), F.sum("score_sum").cast("decimal(38,6)").alias("score_sum"))


def delta(spark: SparkSession, table_root: str, epoch: int) -> DataFrame:
    """What an epoch of the table adds to and takes from the counts; scores may change where counts do not."""
    new, old = keyed.changes(spark, table_root, epoch)
    return _added(_signed(new, 1).unionByName(_signed(old, -1)))


def _applied(spark: SparkSession, counts_root: str) -> list[int]:
    done = (re.search(r"/epoch=(\d+)/_SUCCESS$", p) for p in placed.found(spark, f"{counts_root}/epoch=*/_SUCCESS"))
    return sorted(int(m[1]) for m in done if m)


def counts(spark: SparkSession, counts_root: str, epoch: int | None = None) -> DataFrame:
    """The counts as of an epoch, the newest by default; empty before the first."""
    done = _applied(spark, counts_root)
    epoch = max(done, default=None) if epoch is None else epoch
    if epoch is None:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(f"{counts_root}/epoch={epoch}")


def refresh(spark: SparkSession, table_root: str, counts_root: str) -> list[int]:
    """Apply the finished epochs of the table that the counts lack, in order; returns them."""
    done = _applied(spark, counts_root)
    last = max(done, default=None)
    missing = sorted(e for e in keyed.batches(spark, table_root).values() if last is None or e > last)
    for epoch in missing:
        before = counts(spark, counts_root, last) if last is not None else spark.createDataFrame([], COUNTS)
        after = _added(before.unionByName(delta(spark, table_root, epoch))).filter("n <> 0")
        after.coalesce(1).write.mode("overwrite").parquet(f"{counts_root}/epoch={epoch}")  # a row for each value
        last = epoch
    return missing


def status(spark: SparkSession, counts_root: str, epoch: int | None = None, top_components: int = 10) -> DataFrame:
    """The status summary (dimension, key, n, avg_cvss) read off the kept counts."""
    kept = counts(spark, counts_root, epoch)
    empty = spark.createDataFrame([("total", "all", 0, None)], COUNTS)
    kept = kept.unionByName(empty).groupBy("dimension", "key").agg(F.sum("n").alias("n"), F.sum("score_sum").alias("sum"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "key"))
    average = F.coalesce(F.round(F.try_divide(F.col("sum").cast("double"), F.col("n")), 2), F.lit(0.0))
    return kept.withColumn("rank", rank).filter(
        (F.col("dimension") != "component") | (F.col("rank") <= top_components)).select(
            "dimension", "key", "n", F.when(F.col("dimension") == "total", average).alias("avg_cvss"))


def start(spark: SparkSession, change_dir: str, table_root: str, counts_root: str, checkpoint: str,
          files_per_batch: int = 100, order: tuple[str, ...] = ("seq",)) -> StreamingQuery:
    """Merge files of changed records (the table's columns and `seq`) as they arrive and keep the counts.

    A batch is tagged with the stream's id, which its checkpoint keeps, so a
    batch that is run again after a failure changes neither table nor counts.
    """
    keyed.create(spark, table_root)
    stream = (spark.readStream.schema(spark.read.parquet(change_dir).schema)
              .option("maxFilesPerTrigger", files_per_batch).parquet(change_dir))

    def handle(changed: DataFrame, batch_id: int) -> None:
        session = changed.sparkSession
        keyed.merge(changed, table_root, f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}", order)
        refresh(session, table_root, counts_root)

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
