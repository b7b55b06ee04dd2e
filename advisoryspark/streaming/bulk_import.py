"""Incremental import of feed files, and status counts kept up to date by a stream."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from advisoryspark.operators import merge
from advisoryspark.plans.enrich import enrich
from advisoryspark.schemas import FEED_SCHEMA, TABLE_SCHEMA
from advisoryspark.sources import feed, store


def import_batch(spark: SparkSession, documents: DataFrame, root: str, tag: str, **models) -> None:
    """Enrich the records of feed documents that the table lacks and log them as the batch `tag`.

    Of a repeated id the first one counts, in an order that depends on the
    documents alone.  What the batch itself has logged is ignored when looking
    for known ids, so a replayed batch finds the same new records and writes
    the same rows again.  `models` are the score and category model of `enrich`.
    """
    origin = ("source_file", "place")
    rows = feed.accepted(feed.records(documents, keep=origin))
    fresh = merge.insert_new(store.keys(spark, root, except_batch=tag), rows)
    first = merge.first_seen(fresh, order=(*origin, "Description", "CVSS_Score")).drop(*origin)
    enriched = enrich(first, **models).withColumn("seq", F.lit(0).cast("bigint"))
    store.append_changes(enriched, root, tag)


def start_import(spark: SparkSession, feed_dir: str, root: str, reject_dir: str, checkpoint: str,
                 files_per_batch: int = 100, multiline: bool = True, **models) -> StreamingQuery:
    """Read all new feed files, import them batch by batch and stop.

    Broken documents and records with malformed ids go to `reject_dir` and
    stop nothing.  The models are not retrained here; that is its own job.
    A batch is tagged with the stream's id, which its checkpoint keeps, so other
    imports into the same table, before or after, keep their batches.
    """
    store.create_if_missing(spark, root)
    stream = (
        spark.readStream.schema(FEED_SCHEMA).option("multiLine", multiline)
        .option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files_per_batch).json(feed_dir)
        .withColumn("source_file", F.input_file_name())
    )

    def handle(documents: DataFrame, batch_id: int) -> None:
        session = documents.sparkSession
        tag = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        documents.persist()
        try:
            import_batch(session, documents, root, tag, **models)
            feed.rejected(documents).write.mode("overwrite").json(f"{reject_dir}/batch={tag}")
        finally:
            documents.unpersist()

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def severity_counts(spark: SparkSession, table_dir: str) -> DataFrame:
    """Streaming count by severity over enriched parquet files as they arrive."""
    return (
        spark.readStream.schema(TABLE_SCHEMA).parquet(table_dir)
        .groupBy("True_Severity").agg(F.count(F.lit(1)).alias("n"))
    )


def start_severity_counts(spark: SparkSession, table_dir: str, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts in the in-memory table `name` (complete mode: one row per severity)."""
    return (
        severity_counts(spark, table_dir).writeStream.outputMode("complete").format("memory")
        .queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
