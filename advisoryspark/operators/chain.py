"""Best path through a chain of three states over the whole ordered table.

A row contributes a 3x3 matrix of scores for moving from the state before it to
its own state.  Products of such matrices in (max, +) are associative, so

1. every segment of at most SEGMENT rows is reduced to one matrix,
2. the segments of a chunk are reduced to one matrix per chunk,
3. the driver picks the best states at the chunk edges from one matrix per
   chunk (as many as there are shuffle partitions, whatever the data size),
4. each chunk picks the states at its segment edges, and
5. each segment is replayed between its two known states.

The result is the exact best path; the cut into segments does not change it.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.session import materialize

SEGMENT = 100_000

# Steps(scores, first) -> (rows, 3, 3); `first` marks the first row of the whole sequence.
Steps = Callable[[np.ndarray, bool], np.ndarray]

_IDENTITY = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)


def best_edges(matrices: np.ndarray, entry: int | None, leave: int | None) -> np.ndarray:
    """States before, between and after a run of matrices on the best path."""
    reach = np.zeros(3) if entry is None else _IDENTITY[entry]
    back = []
    for m in matrices:
        options = reach[:, None] + m
        back.append(options.argmax(axis=0))
        reach = options.max(axis=0)
    state = int(reach.argmax()) if leave is None else leave
    states = [state]
    for choice in reversed(back):
        state = int(choice[state])
        states.append(state)
    return np.array(states[::-1])


def _lanes(steps: np.ndarray) -> np.ndarray:
    """Rows as about sqrt(n) lanes of about sqrt(n) steps, padded by no-op steps."""
    length = max(1, int(np.sqrt(len(steps))))
    count = -(-len(steps) // length)
    padded = np.concatenate([steps, np.repeat(_IDENTITY[None], count * length - len(steps), axis=0)])
    return padded.reshape(count, length, 3, 3)


def _lane_products(lanes: np.ndarray) -> np.ndarray:
    product = lanes[:, 0]
    for k in range(1, lanes.shape[1]):
        product = (product[:, :, :, None] + lanes[:, k, None]).max(axis=2)
    return product


def product(steps: np.ndarray) -> np.ndarray:
    """(max, +) product of all steps."""
    total = _IDENTITY
    for m in _lane_products(_lanes(steps)):
        total = (total[:, :, None] + m[None]).max(axis=1)
    return total


def best_path(steps: np.ndarray, entry: int, leave: int) -> np.ndarray:
    """State at every step on the best path between two known states."""
    lanes = _lanes(steps)
    edges = best_edges(_lane_products(lanes), entry, leave)
    reach = _IDENTITY[edges[:-1]]
    back = np.empty(lanes.shape[:3], dtype=np.int8)
    for k in range(lanes.shape[1]):
        options = reach[:, :, None] + lanes[:, k]
        back[:, k] = options.argmax(axis=1)
        reach = options.max(axis=1)
    path = np.empty(lanes.shape[:2], dtype=np.int8)
    state, every = edges[1:], np.arange(len(lanes))
    for k in reversed(range(lanes.shape[1])):
        path[:, k] = state
        state = back[every, k, state]
    return path.reshape(-1)[: len(steps)]


def decode(rows: DataFrame, steps: Steps, segment: int = SEGMENT) -> DataFrame:
    """Rows with the state name on the best path; `rows` come from sequence.ordered_rows."""
    spark = rows.sparkSession
    names = np.array(fx.THREAT_STATES, dtype=object)
    placed = rows.withColumn("segment", F.floor(F.col("pos") / segment).cast("int"))
    first_chunk = rows.agg(F.min("chunk")).first()[0]

    def is_first(pdf: pd.DataFrame) -> bool:
        return pdf["chunk"].iloc[0] == first_chunk and pdf["pos"].iloc[0] == 0

    def reduce_segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        matrix = product(steps(pdf["CVSS_Score"].to_numpy(), is_first(pdf)))
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "segment": pdf["segment"].iloc[:1],
                             "matrix": [matrix.ravel()]})

    # Grouping only id and score; one group holds at most `segment` rows.
    reduced = materialize(
        placed.select("chunk", "segment", "pos", "CVSS_Score").groupBy("chunk", "segment").applyInPandas(
            reduce_segment, "chunk int, segment int, matrix array<double>"), "segments")

    def stack(pdf: pd.DataFrame) -> np.ndarray:
        return np.stack(pdf["matrix"].to_numpy()).reshape(-1, 3, 3)

    def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = product(stack(pdf.sort_values("segment")))
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "matrix": [matrix.ravel()]})

    chunks = reduced.groupBy("chunk").applyInPandas(
        reduce_chunk, "chunk int, matrix array<double>").toPandas().sort_values("chunk")
    edges = best_edges(stack(chunks), None, None)
    chunk_edges = spark.createDataFrame(
        [(int(c), int(a), int(b)) for c, a, b in zip(chunks["chunk"], edges[:-1], edges[1:])],
        "chunk int, entry int, leave int")

    def split_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        inner = best_edges(stack(pdf), pdf["entry"].iloc[0], pdf["leave"].iloc[0])
        return pd.DataFrame({"chunk": pdf["chunk"], "segment": pdf["segment"],
                             "entry": inner[:-1], "leave": inner[1:]})

    segment_edges = reduced.join(F.broadcast(chunk_edges), "chunk").groupBy("chunk").applyInPandas(
        split_chunk, "chunk int, segment int, entry int, leave int")

    def replay(pdf: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        path = best_path(steps(pdf["CVSS_Score"].to_numpy(), is_first(pdf)),
                         edge["entry"].iloc[0], edge["leave"].iloc[0])
        return pdf.drop(columns="segment").assign(state=names[path])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return placed.groupBy("chunk", "segment").cogroup(
        segment_edges.groupBy("chunk", "segment")).applyInPandas(replay, fields + ", state string")
