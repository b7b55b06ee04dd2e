"""Session settings and the shared work folder."""

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


#: Of intermediate and placed tables, most of whose bytes are text.
COMPRESSION = "zstd"


def get_session(app: str = "advisoryspark", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings this package was measured with; `conf` overrides them.

    No operator depends on them: any session gives the same rows.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, named by the session alone.

    spark.checkpoint.dir where it is set, else a folder of the warehouse.  A
    warehouse in a machine's own file system is shared by the executors of a local
    master only, so elsewhere it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if urlparse(warehouse).scheme in ("", "file") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir: {warehouse} is a folder of one machine")
    return os.path.join(warehouse, "advisoryspark-work")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the work folder that nothing else uses."""
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as parquet under the work folder and read it back.

    Cuts the lineage with a table every executor can read again, and keeps
    column pruning for the passes that follow.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """`df` written as an intermediate table, which goes when its readers are done."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
