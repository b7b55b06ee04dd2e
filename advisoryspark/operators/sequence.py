"""The whole table as one chronological sequence, without a one-task window.

A global sort spreads the rows over range partitions of about equal size; the
range partition (`chunk`) and the place in it (`pos`) are written with the rows,
so every later pass sees the same cut.  Work across chunks then needs one small
row per chunk, and the number of chunks is the number of shuffle partitions, a
setting that does not grow with the data.
"""

from pyspark.sql import DataFrame, Window, functions as F

from advisoryspark.functions.scores import threat_state
from advisoryspark.session import materialize

# Bits of monotonically_increasing_id that count the rows of one partition.
_ROW_BITS = 33
# Rows of a chunk that one window holds.
SEGMENT = 100_000


def ordered_rows(df: DataFrame, order=("Year", "CVE_ID"), columns=None) -> DataFrame:
    """Rows in sequence order with chunk and pos, written once.

    `order` ends in the unique key of the table, so no range can be hot.  Only
    the named columns enter the sort.
    """
    rows = df if columns is None else df.select(*columns)
    placed = (
        rows.orderBy(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("chunk", F.shiftright("_id", _ROW_BITS).cast("int"))
        .withColumn("pos", F.col("_id").bitwiseAND(2 ** _ROW_BITS - 1))
        .drop("_id")
    )
    return materialize(placed, "sequence")


def _chunk_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def with_position(rows: DataFrame) -> DataFrame:
    """1-based position of every row in the whole sequence."""
    # One row per chunk, so this window sorts a handful of rows and the
    # broadcast side is as small.
    before = Window.partitionBy(F.lit(1)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _chunk_sizes(rows).select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    return (
        rows.join(F.broadcast(offsets), "chunk")
        .withColumn("position", F.col("rows_before") + F.col("pos") + 1)
        .drop("rows_before")
    )


def with_previous(rows: DataFrame, value: str, name: str, segment: int = SEGMENT) -> DataFrame:
    """Value of the row before in the whole sequence; null for the first row.

    A chunk is cut into segments of `segment` rows, and the last row of each is
    also handed to the next one, so a window holds a segment whatever the size
    of a chunk.  The last row of a chunk goes to the first segment of the next.
    """
    by_chunk = Window.partitionBy(F.lit(1)).orderBy("chunk")  # one row per chunk
    chunks = _chunk_sizes(rows).select(F.col("chunk").alias("_chunk"), F.col("n").alias("_n"),
                                       F.lead("chunk").over(by_chunk).alias("_next"))
    here = F.struct(F.col("chunk").alias("c"), F.floor(F.col("pos") / segment).alias("s"), F.col("pos").alias("p"),
                    F.lit(False).alias("handed"))
    last = F.col("pos") == F.col("_n") - 1
    onward = F.struct(F.when(last, F.col("_next")).otherwise(F.col("chunk")).alias("c"),
                      F.when(last, 0).otherwise(F.floor((F.col("pos") + 1) / segment)).alias("s"),
                      F.when(last, -1).otherwise(F.col("pos")).alias("p"), F.lit(True).alias("handed"))
    places = F.when(last | (F.col("pos") % segment == segment - 1), F.array(here, onward)).otherwise(F.array(here))
    placed = (rows.join(F.broadcast(chunks), F.col("chunk") == F.col("_chunk"))
              .withColumn("_place", F.explode(places)).filter("_place.c IS NOT NULL"))
    before = F.lag(value).over(Window.partitionBy("_place.c", "_place.s").orderBy("_place.p"))
    return placed.withColumn(name, before).filter("NOT _place.handed").select(*rows.columns, name)


def previous_states(rows: DataFrame) -> DataFrame:
    """State and previous state of every row of the sequence but the first; `rows` come from ordered_rows."""
    states = rows.withColumn("state", threat_state(F.col("CVSS_Score")))
    return with_previous(states, "state", "prev_state").filter("prev_state IS NOT NULL")


def last_observation(records: DataFrame) -> DataFrame:
    """The newest record of the sequence, by aggregation instead of a sort."""
    return records.agg(
        F.max_by(F.struct("CVE_ID", "Year", "CVSS_Score"), F.struct("Year", "CVE_ID")).alias("last")
    ).select("last.*").withColumn("state", threat_state(F.col("CVSS_Score")))


def transition_matrix(pairs: DataFrame) -> DataFrame:
    """Observed count and probability of each state following each other state."""
    counts = pairs.groupBy("prev_state", "state").agg(F.count(F.lit(1)).alias("n"))
    row = Window.partitionBy("prev_state")  # at most nine rows are left here
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(row))


def difference(series: DataFrame, value: str = "n", order: str = "t", key: str = "series") -> DataFrame:
    """First difference along each counted series."""
    along = Window.partitionBy(key).orderBy(order)
    return series.withColumn("diff", F.col(value) - F.lag(value).over(along))
