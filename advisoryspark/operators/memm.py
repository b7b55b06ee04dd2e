"""Maximum-entropy Markov model of the threat states.

The label is a function of the score, which is also a feature, so a high
accuracy is expected.
"""

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions.scores import first_argmax, one_hot_state, threat_state
from advisoryspark.operators import chain, evaluation, sequence
from advisoryspark.session import scratch

FEATURES = ["CVSS_Score"] + ["Prev_State_" + s for s in fx.THREAT_STATES]


def _with_state(rows: DataFrame) -> DataFrame:
    return rows.withColumn("state", threat_state(F.col("CVSS_Score")))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def training_rows(rows: DataFrame) -> DataFrame:
    """State, class index and features of every row but the first of the sequence."""
    pairs = sequence.with_previous(_with_state(rows), "state", "prev_state").filter("prev_state IS NOT NULL")
    index = F.array_position(F.array(*[F.lit(s) for s in fx.THREAT_STATES]), F.col("state")) - 1
    return _assembled(pairs.select(
        "CVSS_Score", "state", index.cast("double").alias("label"), *one_hot_state(F.col("prev_state"))))


def fit(rows: DataFrame) -> LogisticRegressionModel:
    """Multinomial regression of the state on the score and the previous true state.

    `rows` come from sequence.ordered_rows.  The penalty 1/n is a unit penalty
    on the summed loss.  The training rows are written for the fit and read by
    every iteration.
    """
    with scratch(training_rows(rows).select("features", "label"), "memm") as training:
        n = training.count()
        return LogisticRegression(
            family="multinomial", regParam=1.0 / n, elasticNetParam=0.0,
            standardization=False, maxIter=200, tol=1e-10).fit(training)


def training_accuracy(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    return evaluation.accuracy(model.transform(training_rows(rows)), "label", "prediction")


def gradient(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """state, feature, gradient of the penalised mean loss at the model's weights: the loss is convex, so the fit is
    its optimum exactly where all of them are zero."""
    trained = model.transform(training_rows(rows)).select("label", *FEATURES, vector_to_array("probability").alias("p"))
    weights, _ = parameters(model)
    off = {k: F.get("p", F.lit(k)) - (F.col("label") == k).cast("double") for k in range(model.numClasses)}
    sums = [F.avg(off[k] * (F.col(f) if f else F.lit(1.0))).alias(f"g{k}_{j}")
            for k in off for j, f in enumerate([*FEATURES, None])]
    totals = trained.agg(F.count(F.lit(1)).alias("n"), *sums)
    cells = [F.struct(F.lit(fx.THREAT_STATES[k]).alias("state"), F.lit(f or "intercept").alias("feature"),
                      (F.col(f"g{k}_{j}") + F.lit(float(weights[k][j]) if f else 0.0) / F.col("n")).alias("gradient"))
             for k in off for j, f in enumerate([*FEATURES, None])]
    return totals.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def parameters(model: LogisticRegressionModel) -> tuple[np.ndarray, np.ndarray]:
    """Weights (class by feature) and intercepts over all three states; an unseen
    state beyond the last trained class gets no chance."""
    weights = np.zeros((3, len(FEATURES)))
    bias = np.full(3, -np.inf)
    k = model.numClasses
    weights[:k] = model.coefficientMatrix.toArray()
    bias[:k] = model.interceptVector.toArray()
    return weights, bias


def decode(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """Greedy decode: each row uses the state predicted for the row before, the
    first row its true state.

    Given its score a row maps the previous state to the next one.  Such maps
    compose, so segments are reduced independently and replayed from their
    known start (see `chain`).
    """
    def steps(scores: np.ndarray, first: bool) -> np.ndarray:
        # (row, previous state, class): the argmax is the predicted state.
        logits = scores[:, None, None] * weights[:, 0] + weights[:, 1:].T[None] + bias
        moves = np.full(logits.shape, -np.inf)
        np.put_along_axis(moves, logits.argmax(axis=2)[..., None], 0.0, axis=2)
        if first:
            moves[0] = -np.inf
            moves[0, :, int(np.digitize(scores[0], [4.0, 7.0]))] = 0.0
        return moves

    decoded = chain.decode(rows, steps)
    return decoded.withColumn("true_state", threat_state(F.col("CVSS_Score")))


def what_if(decoded: DataFrame, model: LogisticRegressionModel, next_score: float = 8.5) -> DataFrame:
    """Label and probability of each state for a given next score after the last row,
    with the share of rows whose decoded state is their true one."""
    last = decoded.agg(F.max_by("state", F.struct("chunk", "pos")).alias("current_state"), decode_accuracy())
    row = _assembled(last.select(
        "current_state", "accuracy", F.lit(float(next_score)).alias("CVSS_Score"), *one_hot_state(F.col("current_state"))))
    names = F.array(*[F.lit(s) for s in fx.THREAT_STATES])
    chances = vector_to_array("probability")
    return model.transform(row).select(
        "current_state", F.col("CVSS_Score").alias("simulated_cvss"),
        F.get(names, F.col("prediction").cast("int")).alias("predicted_next_state"),
        F.map_from_arrays(F.slice(names, 1, F.size(chances)), chances).alias("probabilities"), "accuracy",
    )


def decode_accuracy() -> Column:
    """Share of decoded rows whose state is their true state."""
    return F.avg((F.col("state") == F.col("true_state")).cast("double")).alias("accuracy")


def outlook(decoded: DataFrame, weights: np.ndarray, bias: np.ndarray, next_score: float = 8.5) -> DataFrame:
    """The what-if result for given weights: state after the last row, its probability, decode accuracy."""
    last = decoded.agg(F.max_by("state", F.struct("chunk", "pos")).alias("current_state"), decode_accuracy())
    names = F.array(*[F.lit(s) for s in fx.THREAT_STATES])
    per_state = F.array(*[F.array(*[F.lit(float(weights[k, 0] * next_score + weights[k, 1 + p] + bias[k]))
                                    for k in range(3)]) for p in range(3)])
    logits = F.get(per_state, (F.array_position(names, F.col("current_state")) - 1).cast("int"))
    top = F.array_max(logits)
    best = first_argmax(logits)
    chance = 1 / F.aggregate(logits, F.lit(0.0), lambda total, x: total + F.exp(x - top))
    return last.select("current_state", "accuracy", F.get(names, best).alias("predicted_next_state"),
                       chance.alias("probability"))
