"""Tables whose rows are placed in numbered folders, of which a batch writes only those it touches.

Layout: <root>/epoch=N/batch=TAG/<name>=P/.  The folder of a place in the newest
finished epoch that has one holds all rows of the place.  An epoch is finished once
Spark has put its mark into the batch's folder, so a job that died leaves the table
as it was.  A batch is known by its tag: a new tag gets the next epoch, and a tag
written before keeps its own, so what is run again is written to the same folder.
One writer at a time.
"""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T


@dataclass(frozen=True)
class Folder:
    epoch: int
    batch: str
    place: int
    path: str


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [status.getPath().toString() for status in statuses]


def batches(spark: SparkSession, root: str) -> dict[str, int]:
    """Epoch of each finished batch."""
    done = re.compile(r"/epoch=(\d+)/batch=([^/]+)/_SUCCESS$")
    marks = (done.search(p) for p in found(spark, f"{root}/epoch=*/batch=*/_SUCCESS"))
    return {m[2]: int(m[1]) for m in marks if m}


def epoch_of(spark: SparkSession, root: str, tag: str) -> int:
    """The epoch a batch is written to."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", tag):
        raise ValueError(f"unfit batch tag {tag!r}")
    known = batches(spark, root)
    return known.get(tag, max(known.values(), default=-1) + 1)


def folders(spark: SparkSession, root: str, name: str, before: int | None = None) -> dict[int, Folder]:
    """The folder that holds each place, as of the epochs below `before`."""
    parts = re.compile(rf"/epoch=(\d+)/batch=([^/]+)/{name}=(\d+)$")
    finished = set(batches(spark, root).items())
    held: dict[int, Folder] = {}
    for path in found(spark, f"{root}/epoch=*/batch=*/{name}=*"):
        epoch, batch, place = parts.search(path).groups()
        one = Folder(int(epoch), batch, int(place), path)
        if (batch, one.epoch) in finished and (before is None or one.epoch < before) and (
                one.place not in held or held[one.place].epoch < one.epoch):
            held[one.place] = one
    return held


def read(spark: SparkSession, schema: T.StructType, chosen: list[Folder]) -> DataFrame:
    """Rows of some folders."""
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(f.path for f in chosen))
