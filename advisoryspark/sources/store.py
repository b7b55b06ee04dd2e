"""The enriched table as an append-only parquet log, and its exports.

Layout: <root>/epoch=N/batch=TAG/.  Epoch 0 holds the base with unique keys, later
epochs hold change batches.  A batch is known by its tag: a new tag gets the
number after the newest epoch of the log, and writing a tag again replaces what
it wrote, so a replayed micro-batch changes nothing and batches of different
origin never replace one another.  Writing a batch costs what the batch holds,
whatever the size of the table.  `current` resolves the newest version of each
key; `compact` writes that result as the base of a fresh root.
"""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from advisoryspark import fixed_values as fx
from advisoryspark.functions import text
from advisoryspark.operators import merge
from advisoryspark.schemas import TABLE_COLUMNS, TABLE_SCHEMA
from advisoryspark.session import COMPRESSION
from advisoryspark.sources.tables import seed_records

LOG_SCHEMA = T.StructType(TABLE_SCHEMA.fields + [
    T.StructField("seq", T.LongType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("batch", T.StringType()),
])


def with_defaults(records: DataFrame) -> DataFrame:
    """Records in the table schema: optional columns filled, cleaned text recomputed when empty."""
    for field in TABLE_SCHEMA.fields:
        if field.name not in records.columns:
            records = records.withColumn(field.name, F.lit(None).cast(field.dataType))
    filled = {
        "Year": F.coalesce("Year", F.lit(fx.DEFAULT_YEAR)),
        "CVSS_Score": F.coalesce("CVSS_Score", F.lit(fx.DEFAULT_SCORE)),
        "CWE": F.coalesce("CWE", F.lit(fx.DEFAULT_CWE)),
        "OS": F.coalesce("OS", F.lit(fx.DEFAULT_OS)),
        "Cleaned_Description": F.coalesce(F.nullif("Cleaned_Description", F.lit("")),
                                          text.clean_text(F.col("Description"))),
        "Predicted_Severity": F.coalesce("Predicted_Severity", "True_Severity"),
        "Severity_Confidence": F.coalesce("Severity_Confidence", F.lit(1.0)),
        "BERT_Category": F.coalesce("BERT_Category", F.lit("N/A")),
        "BERT_Confidence": F.coalesce("BERT_Confidence", F.lit(0.0)),
    }
    extra = [c for c in records.columns if c not in TABLE_COLUMNS]
    return records.select(
        *[filled.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in TABLE_SCHEMA.fields],
        *extra,
    )


def add_missing_columns(old: DataFrame) -> DataFrame:
    """An older table with the columns it lacks added as nulls."""
    empty = old.sparkSession.createDataFrame([], TABLE_SCHEMA)
    return empty.unionByName(old, allowMissingColumns=True)


BASE = "base"


def _write_batch(records: DataFrame, root: str, epoch: int, tag: str, mode: str) -> None:
    records.select(*TABLE_COLUMNS, "seq").write.mode(mode).parquet(
        f"{root}/epoch={epoch}/batch={tag}", compression=COMPRESSION)


def _batches(spark: SparkSession, root: str) -> dict[str, int]:
    """Epoch of each batch in the log, from the folder names."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/epoch=*/batch=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = [status.getPath() for status in found]
    return {p.getName().split("=", 1)[1]: int(p.getParent().getName().split("=", 1)[1]) for p in paths}


def create_if_missing(spark: SparkSession, root: str) -> None:
    """Empty table with the fixed schema; an existing one is left alone."""
    empty = spark.createDataFrame([], LOG_SCHEMA)
    _write_batch(empty, root, 0, BASE, "ignore")


def append_changes(batch: DataFrame, root: str, tag: str | None = None) -> None:
    """Log one batch of inserts and updates as it is; readers resolve repeated keys by epoch and seq.

    Without a tag the batch is one of its own; a tag written before keeps its epoch.
    """
    tag = tag or f"manual-{uuid.uuid4().hex}"
    if not re.fullmatch(r"[A-Za-z0-9_-]+", tag) or tag == BASE:
        raise ValueError(f"unfit batch tag {tag!r}")
    known = _batches(batch.sparkSession, root)
    epoch = known.get(tag, max(known.values(), default=0) + 1)
    _write_batch(with_defaults(batch), root, epoch, tag, "overwrite")


def log(spark: SparkSession, root: str) -> DataFrame:
    """All logged versions with their epoch and batch."""
    return spark.read.schema(LOG_SCHEMA).parquet(root)


def current(spark: SparkSession, root: str, with_batch: bool = False) -> DataFrame:
    """Newest version of every key, with the batch it came from if asked for.

    Only the change batches are grouped; the base is anti-joined on their keys,
    which Spark broadcasts when the changes are small.
    """
    versions = log(spark, root)
    merged = merge.upsert(versions.filter("epoch = 0"), versions.filter("epoch > 0"), order=("epoch", "batch", "seq"))
    return merged.select(*TABLE_COLUMNS, *(["batch"] if with_batch else []))


def keys(spark: SparkSession, root: str, except_batch: str) -> DataFrame:
    """Ids logged by all other batches; reads the key column of their folders only."""
    return log(spark, root).filter(F.col("batch") != except_batch).select("CVE_ID")


def compact(spark: SparkSession, root: str, new_root: str) -> None:
    """Write the current table as the base of a fresh root, sorted by year and id.

    The sort gives every file and row group a narrow range of ids, so lookups
    by id or year skip nearly all of them.
    """
    merged = current(spark, root).withColumn("seq", F.lit(0).cast("bigint"))
    _write_batch(merged.orderBy("Year", "CVE_ID"), new_root, 0, BASE, "errorifexists")


def reset(spark: SparkSession, root: str) -> None:
    """Replace all content by the seed records."""
    seeds = seed_records(spark).withColumn("seq", F.lit(0).cast("bigint"))
    seeds.withColumns({"epoch": F.lit(0), "batch": F.lit(BASE)}).write.mode("overwrite").partitionBy(
        "epoch", "batch").option("partitionOverwriteMode", "static").parquet(root)


def seed_if_empty(spark: SparkSession, root: str) -> bool:
    """Load the seed records into an empty table.

    A log without rows is an empty table, as every version counts as a record.
    """
    if not log(spark, root).select("CVE_ID").isEmpty():
        return False
    reset(spark, root)
    return True


def export_csv(records: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV with the export headings; quotes inside a field are doubled.

    All given rows are written, in parallel files; `limit` is the optional
    size of a partial export in listing order.
    """
    if limit is not None:
        records = records.orderBy(F.desc("Year"), F.desc("CVE_ID")).limit(limit)
    named = records.select(*[F.col(c).alias(title) for c, title in fx.EXPORT_COLUMNS])
    (named.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))


def log_predictions(scored: DataFrame, path: str, model_version: str) -> None:
    """Append scored rows with the model version and time, for drift monitoring."""
    stamped = (
        scored.withColumn("model_version", F.lit(model_version))
        .withColumn("scored_at", F.current_timestamp())
    )
    stamped.write.mode("append").partitionBy("model_version").parquet(path)
