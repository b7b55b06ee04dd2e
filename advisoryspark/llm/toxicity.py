"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams (free style).

Features are the distinct words, word pairs and pairs around one word of a text,
hashed to 2**BITS coordinates.  Each coordinate has its own learning rate, and L1
leaves only those weights that carry evidence, so what is broadcast for scoring
is a short sorted list.  The fit reads a bounded sample of labelled rows (`max_rows`,
chosen by a hash of the id); scoring reads all rows and whole texts.

Defined cases: null and empty texts have no feature and get the score of the
bias; null labels and labels without a document are left out of the fit; several
labels of one id count as their largest; without any labelled document every
score is close to 0, so that nothing is rejected; repeated rows are scored each
on its own; an empty table gives an empty result; extra columns are kept by
`reject` and ignored by `score`; a score of exactly the threshold counts as toxic;
a very long text is scored whole, in a numpy step of its own.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import WORD_BYTES, each_step, logistic, mixed, text_of, texts, word_hashes, word_table

BITS = 22
#: Labelled rows the fit reads at most, passes over them.
MAX_ROWS, EPOCHS = 20_000, 4
#: FTRL-proximal: learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
#: Bias where no document is labelled.
NOTHING_LEARNED = -30.0


@dataclass
class Weights:
    """Sorted coordinates with their non-zero weights, a bit per coordinate to pass by the others, and the bias."""

    places: np.ndarray
    values: np.ndarray
    bias: float

    def __post_init__(self):
        self.used = np.zeros(1 << BITS, bool)
        self.used[self.places] = True

    def score(self, starts: np.ndarray, text: np.ndarray, places: np.ndarray) -> np.ndarray:
        hit = self.used[places]
        pairs = np.unique((text[hit] << BITS) | places[hit])  # each feature of a text counts once
        weight = self.values[np.searchsorted(self.places, pairs & ((1 << BITS) - 1))] if len(pairs) else np.zeros(0)
        return logistic(self.bias + np.bincount(pairs >> BITS, weight, minlength=len(starts) - 1))


def feature_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts of each text, and (text number, coordinate) of every feature occurrence."""
    starts, codes, distinct = word_table(column, WORD_BYTES)
    words = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found_text, found = [text], [mixed(words)]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        both = text[:-gap] == text[gap:]
        found_text.append(text[:-gap][both])
        found.append(mixed(words[:-gap] * np.uint64(factor) + words[gap:])[both])
    return starts, np.concatenate(found_text), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct_features(batch: pa.RecordBatch) -> pa.RecordBatch:
    starts, text, places = feature_places(batch.column("text"))
    pairs = np.unique((text << BITS) | places)
    cuts = np.searchsorted(pairs, np.arange(len(starts)) << BITS)
    raw = (pairs & ((1 << BITS) - 1)).astype("<i4").tobytes()
    return pa.record_batch([*(batch.column(k) for k in ("id", "turn", "label")),
                            pa.array([raw[4 * a:4 * b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                           names=["id", "turn", "label", "places"])


def train(rows, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1,
          l2: float = L2) -> Weights:
    """FTRL-proximal over (places, label) in the given order; the last coordinate is the bias, free of L1."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == size - 1, 0, l1), 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for places, label in rows:
            at = np.append(places, size - 1)
            w = weight(at)
            g = logistic(w.sum()) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    if not rows:
        return Weights(np.zeros(0, np.int64), np.zeros(0), NOTHING_LEARNED)
    used = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Weights(used, weight(used), float(weight(np.array([size - 1]))[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS, use: Column | None = None) -> Weights:
    """Weights from at most `max_rows` labelled documents for which `use` (over the id column) holds.

    Features are made where the documents are; the sample's features meet in one
    task, which their bound allows, in the order of the hash.
    """
    labelled = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
                .where(F.lit(True) if use is None else use)
                .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    narrow = docs.select(F.col(id_col).alias("id"))
    turn = F.xxhash64("id")
    sample = (labelled.join(narrow.distinct(), "id", "left_semi").withColumn("turn", turn)
              .orderBy("turn", "id").limit(max_rows))
    sampled = docs.select(F.col(id_col).alias("id"), texts(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = sampled.select("id", "turn", "label", "text")
    schema = rows.select("id", "turn", "label", F.col("text").alias("places")).schema
    # Rows that repeat an id count once, so the bound holds for rows as for ids.
    made = (rows.mapInArrow(lambda it: each_step(it, "text", _distinct_features), schema)
            .groupBy("id", "turn", "label").agg(F.min("places").alias("places")))

    def learn(batches):
        rows = [(np.frombuffer(p, "<i4"), y) for b in batches
                for p, y in zip(b.column("places").to_pylist(), b.column("label").to_pylist())]
        weights = train(rows)
        yield pa.record_batch([
            pa.array([weights.places.astype("<i8").tobytes()]), pa.array([weights.values.astype("<f8").tobytes()]),
            pa.array([weights.bias])], names=["places", "values", "bias"])

    row = (made.repartition(1).sortWithinPartitions("turn", "places")
           .mapInArrow(learn, "places binary, values binary, bias double").first())
    if row is None:
        return Weights(np.zeros(0, np.int64), np.zeros(0), NOTHING_LEARNED)
    return Weights(np.frombuffer(row.places, "<i8"), np.frombuffer(row["values"], "<f8"), row.bias)


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and score from its whole text; no shuffle."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = narrow.select("id", F.lit(0.0).alias("score")).schema

    def result(batch, scores):
        return pa.record_batch([batch.column("id"), pa.array(scores)], names=["id", "score"])

    return narrow.mapInArrow(_scorer(docs, weights, "text", result), schema)


def _scorer(docs, weights, text_col, result):
    sent = docs.sparkSession.sparkContext.broadcast((weights.places, weights.values, weights.bias))

    def run(batches):
        held = Weights(*sent.value)
        return each_step(batches, text_col,
                         lambda batch: result(batch, held.score(*feature_places(text_of(batch, text_col)))))

    return run


def reject(docs: DataFrame, weights: Weights, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` without those that score `threshold` or more; all columns stay."""
    def result(batch, scores):
        return batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(_scorer(docs, weights, text_col, result), docs.schema)
