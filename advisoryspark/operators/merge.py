"""Merging records by key: upsert, insert-only-new, left and anti joins."""

from pyspark.sql import Column, DataFrame, functions as F

KEY = "CVE_ID"


def latest(batch: DataFrame, order=("seq",), key: str = KEY) -> DataFrame:
    """Last row of every key in `order`; rows that tie there go by a hash of the row.

    An aggregate, so each task first reduces its own rows to one per key: a
    key that fills a third of the batch adds one row per task to the shuffle.
    """
    whole, rank = _row_and_rank(batch, order)
    return batch.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, rank).alias("row")).select("row.*")


def first_seen(batch: DataFrame, order=("seq",), key: str = KEY) -> DataFrame:
    whole, rank = _row_and_rank(batch, order)
    return batch.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, rank).alias("row")).select("row.*")


def _row_and_rank(batch: DataFrame, order) -> tuple[Column, Column]:
    columns = [F.col(c) for c in batch.columns]
    return F.struct(*columns), F.struct(*[F.col(c) for c in order], F.xxhash64(*columns))


def upsert(target: DataFrame, batch: DataFrame, order=("seq",), key: str = KEY) -> DataFrame:
    """Target rows the batch does not touch, plus the last version of every batch key.

    The target loses its touched keys by an anti join on the bare batch keys,
    which Spark broadcasts when they are few; its rows are then not moved.
    """
    changed = latest(batch, order, key).select(*target.columns)
    return target.join(batch.select(key), key, "left_anti").select(*target.columns).unionByName(changed)


def insert_new(target: DataFrame, batch: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of the batch whose key the target lacks: one anti join on the target's bare keys."""
    return batch.join(target.select(key), key, "left_anti")


#: Labels a broadcast table may hold.
MAX_LABELS = 100_000


def join_labels(records: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Records joined with a table of one row per label.

    A label may hold a third of the records, so its table is broadcast where it
    is small, which its rows are counted for; else Spark plans the join.
    """
    small = labels.limit(MAX_LABELS + 1).count() <= MAX_LABELS
    return records.join(F.broadcast(labels) if small else labels, key)


def attach_predictions(records: DataFrame, predictions: DataFrame, key: str = KEY) -> DataFrame:
    """Left join on the key: unmatched records get nulls, repeated keys multiply."""
    return records.join(predictions, key, "left")
