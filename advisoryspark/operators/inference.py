"""Batch inference with a model the caller supplies.

The model is built once per Python worker and sees whole texts in Arrow batches.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from advisoryspark import fixed_values as fx
from advisoryspark.functions import replies, scores

_PREDICTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])


def _guarded(predict: Callable, failed):
    """Whole batch at once; if that fails, text by text, with `failed` for the broken ones."""
    def run(texts: np.ndarray) -> list:
        try:
            return list(predict(texts))
        except Exception:
            results = []
            for i in range(len(texts)):
                try:
                    results.append(list(predict(texts[i:i + 1]))[0])
                except Exception:
                    results.append(failed)
            return results
    return run


def predict_category(text: Column, make_model: Callable[[], Callable], batch_size: int = 256,
                     error_label: str = "UNKNOWN") -> Column:
    """Struct (label, score rounded to 3) of a text.

    `make_model()` returns a function from an array of texts to (label, score)
    pairs; a text it fails on gets (error_label, 0.0).
    """
    def load():
        run = _guarded(make_model(), (error_label, 0.0))

        def predict(texts: np.ndarray):
            pairs = run(texts)
            return {"label": np.array([p[0] for p in pairs], dtype=object),
                    "score": np.array([float(p[1]) for p in pairs])}
        return predict

    result = predict_batch_udf(load, return_type=_PREDICTION, batch_size=batch_size)(text)
    return F.struct(result["label"].alias("label"), F.round(result["score"], 3).alias("score"))


def by_length(lengths: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Places of texts in batches of like length whose padded size (texts times the longest) keeps to the budget.

    Longest first, so a batch is padded to its first text; a text beyond the budget is a batch of its own.
    """
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, budget // max(1, int(lengths[order[at]])))
        yield order[at:at + size]
        at += size


def predict_by_length(text: Column, make_model: Callable[[], Callable], budget: int = 1 << 14,
                      error_label: str = "UNKNOWN") -> Column:
    """`predict_category` with batches cut by their size instead of a number of rows.

    `budget` counts white-space tokens.  The texts of an Arrow batch are given to
    the model from the longest to the shortest and the results put back in the
    rows' order, so short texts are not padded to long ones and one long text does
    not fill a batch of hundreds.  A null text is the empty text.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = _guarded(make_model(), (error_label, 0.0))
        for texts in batches:
            texts = texts.fillna("").to_numpy(dtype=object)
            lengths = np.array([len(t.split()) for t in texts], np.int64)
            labels, found = np.empty(len(texts), object), np.zeros(len(texts))
            for places in by_length(lengths, budget):
                pairs = predict(texts[places])
                labels[places] = [p[0] for p in pairs]
                found[places] = [float(p[1]) for p in pairs]
            yield pd.DataFrame({"label": labels, "score": found})

    result = F.pandas_udf(run, _PREDICTION)(text)
    return F.struct(result["label"].alias("label"), F.round(result["score"], 3).alias("score"))


def label_scores(text: Column, make_model: Callable[[], Callable], labels: list[str],
                 batch_size: int = 256) -> Column:
    """Array of one score per candidate label; null where the model fails."""
    def load():
        model = make_model()
        run = _guarded(lambda texts: model(texts, labels), [float("nan")] * len(labels))

        def predict(texts: np.ndarray):
            return np.array([np.asarray(r, dtype=float) for r in run(texts)])
        return predict

    found = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)(text)
    return F.when(~F.exists(found, lambda v: F.isnan(v)), found)


def top_label(label_score: Column, labels: list[str] = fx.ZERO_SHOT_LABELS) -> Column:
    """Struct (upper-case label without its suffix, score rounded to 3) of the best
    label; ('UNKNOWN', 0.0) where there are no scores."""
    best = scores.first_argmax(label_score)
    names = F.array(*[F.lit(n) for n in labels])
    return F.struct(
        F.coalesce(replies.zero_shot_label(F.get(names, best)), F.lit("UNKNOWN")).alias("label"),
        F.coalesce(F.round(F.get(label_score, best), 3), F.lit(0.0)).alias("score"),
    )


def zero_shot_severity(records: DataFrame, make_model: Callable[[], Callable],
                       labels: list[str] = fx.ZERO_SHOT_LABELS, batch_size: int = 256) -> DataFrame:
    """Records with zero_shot_severity and zero_shot_confidence.

    The score array is its own projection, so the model runs once per text.
    """
    scored = records.withColumn("_scores", label_scores(F.col("Description"), make_model, labels, batch_size))
    best = top_label(F.col("_scores"), labels)
    return scored.withColumn("_best", best).withColumns({
        "zero_shot_severity": F.col("_best.label"),
        "zero_shot_confidence": F.col("_best.score"),
    }).drop("_scores", "_best")
