"""The enriched table placed by key: a merge rewrites and a lookup opens only the buckets they touch.

Layout: <root>/buckets=K/ and in it the folders of `placed`, one a bucket.  A bucket
holds the ids with one remainder of their CRC-32, sorted by id, so the smallest and
largest id in a file's footer tell a reader whether to open it.  A merge of a batch
writes a folder for each bucket it touches and no other; merged again under its tag
it writes the same rows into the same epoch.

Rows carry the epoch that last changed them, so what a batch changed can be read back
from the table: the new versions from its folders, the old ones from the folders before.

Defined cases: of equal ids in a batch the last in `order` counts, rows that tie there
go by a hash of the row, so the result does not depend on how the batch is cut; rows
without an id are no records and are left out; an empty batch changes nothing.
"""

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from advisoryspark.operators.merge import KEY
from advisoryspark.schemas import TABLE_COLUMNS, TABLE_SCHEMA
from advisoryspark.session import COMPRESSION, scratch
from advisoryspark.sources import placed, store

CHANGED = "changed"
KEYED_SCHEMA = T.StructType(TABLE_SCHEMA.fields + [T.StructField(CHANGED, T.IntegerType())])


def bucket_count(spark: SparkSession, root: str) -> int:
    """Buckets of the table, from the name of its folder."""
    return int(placed.found(spark, f"{root}/buckets=*")[0].rsplit("=", 1)[1])


def _place(spark: SparkSession, root: str) -> str:
    return f"{root}/buckets={bucket_count(spark, root)}"


def batches(spark: SparkSession, root: str) -> dict[str, int]:
    """Epoch of each finished batch."""
    return placed.batches(spark, _place(spark, root))


def folders(spark: SparkSession, root: str, before: int | None = None) -> dict[int, placed.Folder]:
    """The folder that holds each bucket, as of the epochs below `before`."""
    return placed.folders(spark, _place(spark, root), "bucket", before)


def read(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All current rows, or those as of the epochs below `before`."""
    return placed.read(spark, KEYED_SCHEMA, [*folders(spark, root, before).values()]).select(*TABLE_COLUMNS)


def lookup(spark: SparkSession, root: str, cve_id: str) -> DataFrame:
    """The record with exactly this id; only its bucket is listed for reading."""
    held = folders(spark, root).get(zlib.crc32(cve_id.encode()) % bucket_count(spark, root))
    return placed.read(spark, KEYED_SCHEMA, [held] if held else []).filter(F.col(KEY) == cve_id).select(*TABLE_COLUMNS)


def lookup_many(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """Records of the distinct ids of a table; only buckets that one of them falls into are read."""
    k = bucket_count(spark, root)
    touched = {r.bucket for r in ids.select(_bucket(k).alias("bucket")).distinct().collect()}  # K at most
    held = placed.read(spark, KEYED_SCHEMA, [f for b, f in folders(spark, root).items() if b in touched])
    return held.join(ids.select(KEY), KEY, "left_semi").select(*TABLE_COLUMNS)


def _bucket(k: int) -> Column:
    return (F.crc32(F.col(KEY).cast("binary")) % k).cast("int")


def create(spark: SparkSession, root: str, buckets: int = 64) -> None:
    """An empty table; an existing one is left alone.

    `buckets` is chosen so that one holds some gigabytes: a merge sorts and
    writes it in as many tasks as its rows need, not in one.
    """
    if not placed.found(spark, f"{root}/buckets=*"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/buckets={buckets}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def _losers(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Row numbers of the versions that a later one of their id in the same batch replaces."""
    rank = F.struct(*order, "hash", "row")
    last = rows.groupBy(KEY).agg(F.max(rank).alias("best")).select(F.col("best.row").alias("row"))
    return rows.select("row").join(last, "row", "left_anti")


def merge(batch: DataFrame, root: str, tag: str, order: tuple[str, ...] = ("seq",)) -> int:
    """Upsert a batch and return its epoch; reads and writes the buckets of the batch's ids only.

    Versions are compared on ids, order and hash alone; whole rows are moved once, to their
    place.  There the new version of an id comes before the old one, which is left out.
    """
    spark = batch.sparkSession
    k, place = bucket_count(spark, root), _place(spark, root)
    epoch = placed.epoch_of(spark, place, tag)
    rows = store.with_defaults(batch).filter(F.col(KEY).isNotNull())
    numbered = rows.withColumns({"hash": F.xxhash64(*rows.columns), "row": F.monotonically_increasing_id()})
    with scratch(numbered, "merge") as numbered, scratch(_losers(numbered, order), "losers") as losers:
        new = numbered if losers.isEmpty() else numbered.join(losers, "row", "left_anti")
        new = new.select(*TABLE_COLUMNS, F.lit(epoch).alias(CHANGED))
        touched = {r.bucket for r in numbered.select(_bucket(k).alias("bucket")).distinct().collect()}  # K at most
        held = folders(spark, root, before=epoch)
        old = placed.read(spark, KEYED_SCHEMA, [held[b] for b in touched if b in held])
        merged = old.unionByName(new).withColumn("bucket", _bucket(k)).repartitionByRange("bucket", KEY)
        newest = Window.partitionBy("bucket", KEY).orderBy(F.desc(CHANGED))
        (merged.withColumn("version", F.row_number().over(newest)).filter("version = 1").drop("version")
         .write.mode("overwrite").partitionBy("bucket").option("compression", COMPRESSION)
         .parquet(f"{place}/epoch={epoch}/batch={tag}"))
    return epoch


def changes(spark: SparkSession, root: str, epoch: int) -> tuple[DataFrame, DataFrame]:
    """The versions that an epoch wrote and those that they replaced, from the buckets it touched."""
    written = {b: f for b, f in folders(spark, root, before=epoch + 1).items() if f.epoch == epoch}
    held = folders(spark, root, before=epoch)
    new = placed.read(spark, KEYED_SCHEMA, [*written.values()]).filter(F.col(CHANGED) == epoch)
    old = placed.read(spark, KEYED_SCHEMA, [held[b] for b in written if b in held])
    return new.select(*TABLE_COLUMNS), old.join(new.select(KEY), KEY, "left_semi").select(*TABLE_COLUMNS)
