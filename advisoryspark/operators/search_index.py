"""Substring search by trigrams: a term's trigrams choose the records whose texts are read.

The index at <root> has two tables (and an empty one that tells the columns).  `texts/segment=S/` holds the records, SEGMENT
rows to a folder.  `postings/` says which rows of a segment hold a trigram (three code
points of the lower-cased searched columns) and is sorted by trigram, so a reader
skips all files and row groups but those of the trigrams it asks for.  A term is cut
at its wildcards; a record can only match if it holds all trigrams of all pieces.
Only the folders with such candidates are read (up to MAX_FOLDERS; beyond, the
candidates are joined with all texts), and candidates are verified with the plain
predicate, so a search finds exactly what a scan finds.  A term without a piece of
three code points scans.

A task builds the postings of its rows alone: each text's distinct trigrams are sorted
in numpy, and only (trigram, rows of one segment) leave the task.  A frequent trigram
has one row of postings for each segment, which the range sort spreads over files.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from advisoryspark.operators import listing
from advisoryspark.session import materialize, scratch

#: Rows in a folder of texts.
SEGMENT = 1 << 16
#: Trigrams a task collects before they leave as postings.
OPEN_GRAMS = 1 << 21
#: Folders of candidates that are named to the scan; their numbers come to the driver.
MAX_FOLDERS = 100_000
_BITS = 21  # of a code point


def _all_grams(text: str) -> np.ndarray:
    """Trigrams of a text as numbers, in its order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    return points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:]


def _grams(text: str) -> np.ndarray:
    """Distinct trigrams of a text as numbers."""
    return np.unique(_all_grams(text))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, segment, rows): the places of a segment's records that hold the trigram."""
    open_rows, held = [], 0

    def out():
        open_rows.sort(key=lambda row: row[:2])
        sizes = [len(found) for *_, found in open_rows]
        gram = np.concatenate([found for *_, found in open_rows])
        segment, place = (np.repeat(np.array([row[i] for row in open_rows], np.int64), sizes) for i in (0, 1))
        open_rows.clear()
        order = np.argsort(gram, kind="stable")
        gram, place, segment = gram[order], place[order], segment[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (segment[1:] != segment[:-1])
        first = np.flatnonzero(new)
        starts = np.append(first, len(gram)).astype(np.int32)
        return pa.record_batch([pa.array(gram[first]), pa.array(segment[first]),
                                pa.ListArray.from_arrays(pa.array(starts), pa.array(place))],
                               names=["gram", "segment", "rows"])

    for batch in batches:
        for segment, place, *texts in zip(*(c.to_pylist() for c in batch.columns)):
            found = np.unique(np.concatenate([_all_grams(t) for t in texts if t] or [np.zeros(0, np.int64)]))
            open_rows.append((segment, place, found))
            held += len(found)
            if held > OPEN_GRAMS:
                yield out()
                held = 0
    if open_rows:
        yield out()


def build(records: DataFrame, root: str, segment_rows: int = SEGMENT) -> None:
    """Write the index of the records at a fresh root."""
    spark = records.sparkSession
    numbered = records.withColumn("place", F.monotonically_increasing_id())
    numbered = numbered.withColumn("segment", F.floor(F.col("place") / segment_rows))
    numbered.limit(0).write.parquet(f"{root}/columns")  # the columns, also of an empty table
    numbered.write.partitionBy("segment").parquet(f"{root}/texts")
    searched = [F.lower(c).alias(c) for c in listing.SEARCHED]
    lowered = texts(spark, root).select("segment", "place", *searched)
    # The range sort reads its input twice, to sample it and to deal it out.
    with scratch(lowered.mapInArrow(_postings, "gram long, segment long, rows array<long>"), "postings") as postings:
        (postings.repartitionByRange("gram", "segment").sortWithinPartitions("gram", "segment")
         .write.parquet(f"{root}/postings"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """All records of the index, with the folder and row number they are filed under."""
    return spark.read.schema(spark.read.parquet(f"{root}/columns").schema).parquet(f"{root}/texts")


def term_grams(spark: SparkSession, term: str) -> list[int]:
    """Trigrams that every match holds, of the term as Spark lower-cases it, cut at its wildcards."""
    lowered = spark.createDataFrame([(term,)], "term string").select(F.lower("term")).first()[0]
    pieces = [_grams(p) for p in re.split("[%_]", lowered)]
    return sorted(set(np.concatenate(pieces).tolist()))


def candidates(spark: SparkSession, root: str, grams: list[int]) -> DataFrame:
    """(segment, place) of the records that hold all of the trigrams; each row has a trigram once."""
    postings = spark.read.parquet(f"{root}/postings").filter(F.col("gram").isin(grams))
    held = postings.select("segment", F.explode("rows").alias("place"))
    return (held.groupBy("segment", "place").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(grams)).select("segment", "place"))


def search(spark: SparkSession, root: str, term: str) -> DataFrame:
    """Records that `listing.search_predicate` holds for, found through the index."""
    whole = texts(spark, root)
    grams = term_grams(spark, term)
    if grams:
        found = materialize(candidates(spark, root, grams), "candidates")
        folders = [r.segment for r in found.select("segment").distinct().limit(MAX_FOLDERS + 1).collect()]
        if len(folders) <= MAX_FOLDERS:
            whole = whole.filter(F.col("segment").isin(folders))
        whole = whole.join(found.select("place"), "place", "left_semi")
    return whole.filter(listing.search_predicate(term)).drop("segment", "place")
