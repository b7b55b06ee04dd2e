"""Connected components of a table of links, without any of it on the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every node that has a link, with the smallest node of its component: (node, root).

    Each round points a node to its smallest neighbour or itself, follows that
    pointer once more, and replaces the links by links between what their ends
    point to.  Falling chains halve in a round and stars vanish in one, so the
    links die out in a few rounds; then the rounds' pointers are followed in
    turn.  Each round is a table in the shared folder, so a lost executor costs
    the running round only.  A node's links are reduced to one row in each task.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pointers = []
    while True:
        both = links.union(links.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to"))
        step = materialize(step, "pointers")
        if step.isEmpty():
            break
        far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = materialize(step.join(far, "to").select("node", F.col("far").alias("to")), "pointers")
        pointers.append(step)
        left, right = (step.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        links = (links.join(left, "a").join(right, "b").where("a_to <> b_to")
                 .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        links = materialize(links, "links")
    if not pointers:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = pointers[0].withColumnRenamed("to", "root")
    for step in pointers[1:]:
        out = (out.join(step.select(F.col("node").alias("root"), "to"), "root", "left")
               .select("node", F.coalesce("to", "root").alias("root")))
    return out
