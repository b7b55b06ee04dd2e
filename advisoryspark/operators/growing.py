"""A chronological sequence that grows by batches, decoded without starting over.

The rows (Year, CVE_ID, CVSS_Score) lie in segments, ranges of the order with at most
SEGMENT rows, each in a folder of `placed`.  A batch rewrites the segments that its
rows fall into; one that grows too large is cut into new ones.  For a model, the
(max, +) product of a segment's 3x3 steps is kept as a row (segment, epoch): products
compose in any grouping, so after a batch only the segments it rewrote are reduced
again, and the best states at all segment edges follow from one matrix a segment on
the driver.  The path inside a segment is replayed between its two edge states when it
is asked for; the newest state needs no rows at all.

Layout: <root>/rows/ (see `placed`), <root>/cuts/epoch=N/ (the first key of each
segment as of an epoch; an epoch counts when it is there) and <root>/products/<model>/.

Defined cases: a row of a batch replaces the row with its key; of equal keys in a batch
the last by `order` counts, ties by a hash of the row; an empty batch changes nothing;
a sequence without rows has no state and an empty path.
"""

import hashlib
import json
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from advisoryspark import fixed_values as fx
from advisoryspark.operators import chain, sequence
from advisoryspark.session import scratch
from advisoryspark.sources import placed

SEGMENT = chain.SEGMENT
KEYS = ("Year", "CVE_ID")
ROWS = T.StructType([T.StructField("CVE_ID", T.StringType()), T.StructField("Year", T.StringType()),
                     T.StructField("CVSS_Score", T.DoubleType())])
CUTS = "Year string, CVE_ID string, segment int"
PRODUCTS = "segment int, epoch int, matrix array<double>"


def _epochs(spark: SparkSession, root: str) -> list[int]:
    done = (re.search(r"/epoch=(\d+)/_SUCCESS$", p) for p in placed.found(spark, f"{root}/cuts/epoch=*/_SUCCESS"))
    return sorted(int(m[1]) for m in done if m)


def cuts(spark: SparkSession, root: str, before: int | None = None) -> list[tuple[str, str, int]]:
    """First key and number of each segment in order: one for every SEGMENT rows or fewer."""
    done = [e for e in _epochs(spark, root) if before is None or e < before]
    if not done:
        return [("", "", 0)]
    return sorted(tuple(r) for r in spark.read.schema(CUTS).parquet(f"{root}/cuts/epoch={done[-1]}").collect())


def segments(spark: SparkSession, root: str, before: int | None = None) -> dict[int, placed.Folder]:
    """Folder of each segment, in order of the sequence; segments without rows are left out."""
    done = set(_epochs(spark, root))
    last = max((e for e in done if before is None or e < before), default=-1)
    held = placed.folders(spark, f"{root}/rows", "segment", last + 1)
    return {s: held[s] for _, _, s in cuts(spark, root, before) if s in held}


def _segment_of(rows: DataFrame, bounds: list[tuple[str, str, int]]) -> DataFrame:
    lows, numbers = [b[:2] for b in bounds], [b[2] for b in bounds]

    @F.pandas_udf("int")
    def number(year: pd.Series, cve_id: pd.Series) -> pd.Series:
        return pd.Series([numbers[bisect_right(lows, key) - 1] for key in zip(year, cve_id)], dtype="int32")

    return rows.withColumn("segment", number(*KEYS))


def append(batch: DataFrame, root: str, tag: str, order: tuple[str, ...] = (), segment: int = SEGMENT) -> int:
    """Put a batch into the sequence and return its epoch; only segments its rows fall into are read and written."""
    spark = batch.sparkSession
    epoch = placed.epoch_of(spark, f"{root}/rows", tag)
    bounds = cuts(spark, root, before=epoch)
    rank = F.struct(*order, F.xxhash64("CVSS_Score"), F.col("CVSS_Score"))
    newest = (batch.filter(F.col("Year").isNotNull() & F.col("CVE_ID").isNotNull())
              .groupBy(*KEYS).agg(F.max_by("CVSS_Score", rank).alias("CVSS_Score")))
    with scratch(_segment_of(newest, bounds).select(*ROWS.names, "segment"), "grown") as new:
        touched = [r.segment for r in new.select("segment").distinct().collect()]  # segments at most
        held = segments(spark, root, before=epoch)
        old = [placed.read(spark, ROWS, [held[s]]).withColumn("segment", F.lit(s)) for s in touched if s in held]
        merged = new
        for rows in old:
            merged = merged.unionByName(rows.join(new.select(*KEYS), list(KEYS), "left_anti"))
        sizes = {r.segment: r["count"] for r in merged.groupBy("segment").count().collect()}
        large = [s for s, n in sizes.items() if n > segment]
        parts = merged.filter(~F.col("segment").isin(large))
        if large:
            pieces, bounds = _cut(merged.filter(F.col("segment").isin(large)), bounds, segment)
            parts = parts.unionByName(pieces)
        (parts.repartitionByRange("segment", *KEYS).sortWithinPartitions("segment", *KEYS)
         .write.mode("overwrite").partitionBy("segment").parquet(f"{root}/rows/epoch={epoch}/batch={tag}"))
    (spark.createDataFrame(bounds, CUTS).coalesce(1).write.mode("overwrite")  # one row a segment
     .parquet(f"{root}/cuts/epoch={epoch}"))
    return epoch


def _cut(rows: DataFrame, bounds: list[tuple[str, str, int]], segment: int):
    """Rows of too large segments under new numbers, and the bounds with these."""
    spark, key = rows.sparkSession, ["segment", "chunk", "part"]
    ordered = sequence.ordered_rows(rows, order=KEYS).withColumn("part", F.floor(F.col("pos") / segment).cast("int"))
    found = ordered.groupBy(*key).agg(F.min(F.struct(*KEYS)).alias("low")).collect()  # one row a new segment
    found.sort(key=lambda r: (r.segment, r.low.Year, r.low.CVE_ID))
    old = {s: (year, cve_id) for year, cve_id, s in bounds}
    number, seen, names, fresh = max(old), set(), [], []
    for r in found:
        number += 1
        low = (r.low.Year, r.low.CVE_ID) if r.segment in seen else old[r.segment]  # the first keeps the old bound
        seen.add(r.segment)
        fresh.append((*low, number))
        names.append((r.segment, r.chunk, r.part, number))
    named = spark.createDataFrame(names, "segment int, chunk int, part int, number int")
    pieces = ordered.join(F.broadcast(named), key).withColumn("segment", F.col("number")).select(*ROWS.names, "segment")
    return pieces, sorted([b for b in bounds if b[2] not in seen] + fresh)


def model_name(model: dict) -> str:
    return hashlib.sha256(json.dumps(model, sort_keys=True).encode()).hexdigest()[:16]


def products(spark: SparkSession, root: str, steps: chain.Steps, name: str) -> dict[int, np.ndarray]:
    """Product of each segment in order; those not reduced under this model before are read and reduced."""
    held = segments(spark, root)
    place = f"{root}/products/{name}"
    known = {}
    if placed.found(spark, f"{place}/*"):
        known = {(r.segment, r.epoch): r.matrix for r in spark.read.schema(PRODUCTS).parquet(place).collect()}
    missing = {s: f for s, f in held.items() if (s, f.epoch) not in known}
    if missing:
        first = next(iter(held))
        reduced = _rows(spark, missing).groupBy("segment", "epoch").applyInPandas(
            lambda pdf: _reduced(pdf, steps, first), PRODUCTS)
        reduced.write.mode("append").parquet(place)
        wanted = {(s, f.epoch) for s, f in missing.items()}
        known |= {(r.segment, r.epoch): r.matrix for r in spark.read.schema(PRODUCTS).parquet(place).collect()
                  if (r.segment, r.epoch) in wanted}
    return {s: np.reshape(known[s, f.epoch], (3, 3)) for s, f in held.items()}


def _rows(spark: SparkSession, chosen: dict[int, placed.Folder]) -> DataFrame:
    """Rows of segments with the segment's number and epoch, read off the names of their folders."""
    rows = placed.read(spark, ROWS, [*chosen.values()]).withColumn("path", F.input_file_name())
    return rows.select(*ROWS.names, F.regexp_extract("path", r"/segment=(\d+)/", 1).cast("int").alias("segment"),
                       F.regexp_extract("path", r"/epoch=(\d+)/", 1).cast("int").alias("epoch"))


def _reduced(pdf: pd.DataFrame, steps: chain.Steps, first: int) -> pd.DataFrame:
    pdf = pdf.sort_values(list(KEYS))
    matrix = chain.product(steps(pdf["CVSS_Score"].to_numpy(), pdf["segment"].iloc[0] == first))
    return pdf[["segment", "epoch"]].head(1).assign(matrix=[matrix.ravel()])


def edges(spark: SparkSession, root: str, steps: chain.Steps, name: str) -> dict[int, tuple[int, int]]:
    """States before and behind each segment on the best path of the whole sequence."""
    kept = products(spark, root, steps, name)
    if not kept:
        return {}
    states = chain.best_edges(np.stack([*kept.values()]), None, None)
    return {s: (int(a), int(b)) for s, a, b in zip(kept, states[:-1], states[1:])}


def newest_state(spark: SparkSession, root: str, steps: chain.Steps, name: str) -> str | None:
    """State at the end of the sequence."""
    found = edges(spark, root, steps, name)
    return fx.THREAT_STATES[[*found.values()][-1][1]] if found else None


def decode(spark: SparkSession, root: str, steps: chain.Steps, name: str, since: tuple[str, str] = ("", "")) -> DataFrame:
    """CVE_ID, Year, CVSS_Score and state of every row from the key `since` on; segments before it are not read."""
    found, held = edges(spark, root, steps, name), segments(spark, root)
    bounds = cuts(spark, root)
    behind = {s for (year, cve_id, _), (_, _, s) in zip(bounds[1:], bounds) if (year, cve_id) <= since}
    chosen = {s: f for s, f in held.items() if s not in behind}
    names, first = np.array(fx.THREAT_STATES, dtype=object), next(iter(held), None)
    if not chosen:
        return spark.createDataFrame([], "CVE_ID string, Year string, CVSS_Score double, state string")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, number = pdf.sort_values(list(KEYS)), int(pdf["segment"].iloc[0])
        path = chain.best_path(steps(pdf["CVSS_Score"].to_numpy(), number == first), *found[number])
        return pdf[ROWS.names].assign(state=names[path])

    path = _rows(spark, chosen).groupBy("segment").applyInPandas(
        replay, "CVE_ID string, Year string, CVSS_Score double, state string")
    return path.filter((F.col("Year") > since[0]) | ((F.col("Year") == since[0]) & (F.col("CVE_ID") >= since[1])))
