"""Incremental import that keeps the known ids in the stream's own state.

`bulk_import` looks for known ids by an anti join over the ids of the whole table, so
a batch costs what the table holds.  Here every id that came through the stream is an
entry of its keyed state store (RocksDB, in the checkpoint), seeded once with the ids
that the table has when the stream is started first: a batch then looks up its own
ids, whatever the size of the table.  State is partitioned by id over the executors
and comes back with the checkpoint after a restart.  Ids are handed over by bucket, a
data frame for each bucket of a batch, since one for each id costs far more than its
look-up; a task holds the new records of one bucket.  A checkpoint of a stream that
kept one value for each id cannot be continued: start with a new one, which is seeded
from the table.

The state knows what the table held at the first start and what the stream itself
imported.  A table that other imports write to at the same time needs `bulk_import`.

Defined cases: of several records of one id in a batch the first by file and place
counts, later ones are known; records with malformed ids and broken documents go to
`reject_dir` by a stream of their own; a replayed batch writes the same rows.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from advisoryspark.operators.merge import KEY
from advisoryspark.plans.enrich import enrich
from advisoryspark.schemas import FEED_SCHEMA
from advisoryspark.sources import feed, store

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of ids that are handed to Python together; part of a checkpoint's state, so it stays as it is.
BUCKETS = 1024
_BUCKET = "_bucket"
_ORDER = ["source_file", "place", "Description", "CVSS_Score"]


class FirstOfId(StatefulProcessor):
    """Emits the first record of every id of a bucket that was never seen, and remembers the id."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "id string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heads = [_first_rows(part) for part in rows]
        if not heads:
            return
        first = _first_rows(pd.concat(heads)) if len(heads) > 1 else heads[0]
        fresh = first[[not self.known.containsKey((one,)) for one in first[KEY]]]
        if len(fresh):
            for one in fresh[KEY]:
                self.known.updateValue((one,), (True,))
            yield fresh[self.columns]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for one in initialState[KEY]:
            self.known.updateValue((one,), (True,))

    def close(self) -> None:
        pass


def _first_rows(part: pd.DataFrame) -> pd.DataFrame:
    return part.sort_values(_ORDER, kind="stable").drop_duplicates(KEY)


@contextmanager
def _rocks_state(spark: SparkSession):
    """Keyed state needs the RocksDB provider; a query takes the setting as it is when it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def unseen(records: DataFrame, known: DataFrame) -> DataFrame:
    """The first record of every id of a stream that neither `known` (a table of ids) nor the stream had before."""
    bucket = F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).alias(_BUCKET)
    return records.select("*", bucket).groupBy(_BUCKET).transformWithStateInPandas(
        FirstOfId(records.columns), records.schema, "Append", "None",
        initialState=known.select(KEY).distinct().select(bucket, KEY).groupBy(_BUCKET))


def start(spark: SparkSession, feed_dir: str, root: str, reject_dir: str, checkpoint: str, files_per_batch: int = 100,
          multiline: bool = True, **models) -> list[StreamingQuery]:
    """Import all new feed files into the table log at `root` and stop: the import and the stream of rejects."""
    store.create_if_missing(spark, root)
    stream = (spark.readStream.schema(FEED_SCHEMA).option("multiLine", multiline).option("mode", "PERMISSIVE")
              .option("maxFilesPerTrigger", files_per_batch).json(feed_dir)
              .withColumn("source_file", F.input_file_name()))
    records = feed.accepted(feed.records(stream, keep=("source_file", "place")))

    def tag(batch: DataFrame, batch_id: int) -> str:
        return f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"

    def handle(fresh: DataFrame, batch_id: int) -> None:
        enriched = enrich(fresh.drop("source_file", "place"), **models).withColumn("seq", F.lit(0).cast("bigint"))
        store.append_changes(enriched, root, tag(fresh, batch_id))

    def reject(bad: DataFrame, batch_id: int) -> None:
        bad.write.mode("overwrite").json(f"{reject_dir}/batch={tag(bad, batch_id)}")

    with _rocks_state(spark):
        imported = (unseen(records, store.log(spark, root).select(KEY)).writeStream.foreachBatch(handle)
                    .option("checkpointLocation", f"{checkpoint}/import").trigger(availableNow=True).start())
    rejects = (feed.rejected(stream).writeStream.foreachBatch(reject)
               .option("checkpointLocation", f"{checkpoint}/rejects").trigger(availableNow=True).start())
    return [imported, rejects]
