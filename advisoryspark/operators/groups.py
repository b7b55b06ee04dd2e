"""Groups of records that share a key, and a split that keeps each group on one side.

Two records belong together if they have an equal value in any of the key columns, or
are linked by a chain of such records.  Labels start as the record's own id; a round
takes the smallest label of each value, then of each record's values, and follows the
label's own label once more, so chains halve from round to round.  Labels of a value are
reduced in each task first, so a value that a third of the records hold is one row a task.
"""

from pyspark.sql import Column, DataFrame, functions as F

from advisoryspark.session import materialize
from advisoryspark.sources import tables

#: Groups with this share of the rows or more are dealt to the sides by size, not by hash.
LARGE = 0.01


def groups(records: DataFrame, id_column: str, keys: dict[str, Column]) -> DataFrame:
    """id and group_id (the smallest id of its group) of every distinct id; a null key value links nothing."""
    cells = [F.struct(F.lit(name).alias("key"), F.md5(value.cast("string")).alias("value")) for name, value in keys.items()]
    named = records.select(F.col(id_column).alias("id"), F.explode(F.array(*cells)).alias("c")).select("id", "c.*")
    held = materialize(named.filter("value IS NOT NULL").distinct(), "keys")
    shared = held.join(held.groupBy("key", "value").count().filter("count > 1"), ["key", "value"]).select("key", "value", "id")
    shared = materialize(shared, "shared")
    labels = materialize(shared.select("id", F.col("id").alias("label")).distinct(), "labels")
    while True:
        least = shared.join(labels, "id").groupBy("key", "value").agg(F.min("label").alias("label"))
        step = shared.join(least, ["key", "value"]).groupBy("id").agg(F.min("label").alias("label"))
        step = materialize(step, "labels")
        onward = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = materialize(step.join(onward, "label").select("id", F.col("further").alias("label")), "labels")
        moved = step.join(labels.withColumnRenamed("label", "before"), "id").filter("label <> before")
        labels, done = step, moved.isEmpty()
        if done:
            break
    every = records.select(F.col(id_column).alias("id")).distinct()
    return every.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("group_id"))


def split(grouped: DataFrame, train: int = 80, validation: int = 10, large: float = LARGE) -> DataFrame:
    """Rows (id, group_id) with `side`; all rows of a group are on one side.

    A group's side is drawn by the hash of its id.  Groups with a share of `large` or
    more, of which there are 1 / large at most, are dealt by size first: each goes to
    the side that lacks most rows of its due.  So no side is farther from its share than
    by the largest group and what the hash scatters of groups under `large`.
    """
    sizes = materialize(grouped.groupBy("group_id").count(), "sizes")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    due = {"train": total * train / 100, "validation": total * validation / 100,
           "test": total * (100 - train - validation) / 100}
    dealt = []
    for row in sizes.filter(F.col("count") >= max(2, large * total)).orderBy(F.desc("count"), "group_id").collect():
        side = max(due, key=due.get)
        due[side] -= row["count"]
        dealt.append((row["group_id"], side))
    drawn = tables.split_name(F.col("group_id"), train, validation)
    if not dealt:
        return grouped.withColumn("side", drawn)
    spark = grouped.sparkSession
    listed = spark.createDataFrame(dealt, f"group_id {grouped.schema['group_id'].dataType.simpleString()}, dealt string")
    return grouped.join(F.broadcast(listed), "group_id", "left").withColumn(
        "side", F.coalesce("dealt", drawn)).select("id", "group_id", "side")
