"""Gaussian hidden Markov model with three states over the chronological scores.

Fitting is Baum-Welch with one Spark pass per iteration.  The expected counts of
a stretch of rows, for each state before and after it, combine associatively
with those of the next stretch.  So each task folds its rows into one small
summary, with no shuffle, and the driver folds one summary per task.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.operators import chain
from advisoryspark.functions.scores import first_argmax

STATES = 3
MAX_ITERATIONS = 100
TOLERANCE = 1e-2
VARIANCE_PRIOR = 1e-2

# Expected quantities: 3 state counts, 3 sums, 3 square sums, 9 transitions, 3 states of the first row.
_STATS = 21


def _log_density(x: np.ndarray, model: dict) -> np.ndarray:
    mean, var = np.array(model["means"]), np.array(model["variances"])
    return -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)


def _step_weights(x: np.ndarray, model: dict, first: bool):
    """Per row the matrix of transition times density, scaled, and the log of the scale."""
    log_b = _log_density(x, model)
    top = log_b.max(axis=1)
    steps = np.array(model["transmat"])[None] * np.exp(log_b - top[:, None])[:, None, :]
    if first:
        steps[0] = np.array(model["startprob"]) * np.exp(log_b[0] - top[0])
    return steps, top


def _compose(a, b):
    """Summary of a stretch followed by another: weight, statistics, log scale."""
    w = a[0] @ b[0]
    s = a[1] @ b[0] + a[0] @ b[1]
    scale = w.max()
    return w / scale, s / scale, a[2] + b[2] + np.log(scale)


def _summary(x: np.ndarray, model: dict, first: bool):
    """Weight (3x3), statistics (21x3x3) and log scale of consecutive rows.

    Rows are laid out in lanes that advance together.  With the products of
    the steps up to each row and after it, all statistics of a lane are plain
    matrix products over its rows; the lanes are then composed in order.
    """
    steps, top = _step_weights(x, model, first)
    length = max(1, int(np.sqrt(len(x)) / 2))
    count = -(-len(x) // length)
    fill = count * length - len(x)

    def lanes(values: np.ndarray, padding) -> np.ndarray:
        padded = np.concatenate([values, np.broadcast_to(padding, (fill, *values.shape[1:]))])
        return padded.reshape(count, length, *values.shape[1:])

    real, steps, x = lanes(np.ones(len(x)), 0.0), lanes(steps, np.eye(STATES)), lanes(x, 0.0)
    before, after = np.empty_like(steps), np.empty_like(steps)
    scale, rest = np.empty((count, length)), np.empty((count, length))
    product = np.broadcast_to(np.eye(STATES), (count, STATES, STATES))
    for k in range(length):
        before[:, k] = product
        product = product @ steps[:, k]
        scale[:, k] = product.max(axis=(1, 2))
        product = product / scale[:, k, None, None]
    weight, log_scale = product, np.log(scale).sum(axis=1)
    # `before` is scaled by the steps so far, so steps scaled alike keep all rows comparable.
    steps = steps / scale[..., None, None]
    product = np.broadcast_to(np.eye(STATES), (count, STATES, STATES))
    for k in reversed(range(length)):
        after[:, k] = product
        product = steps[:, k] @ product

    moved, started = real.copy(), np.zeros_like(real)
    if first:
        moved[0, 0], started[0, 0] = 0.0, 1.0  # the first row starts the chain, it is no transition
    stats = np.empty((count, _STATS, STATES, STATES))
    for j in range(STATES):
        tail = after[:, :, j, :]
        arrive = [before[..., i] * steps[:, :, None, i, j] for i in range(STATES)]
        visits = (sum(arrive) * real[..., None]).transpose(0, 2, 1)
        stats[:, 18 + j] = (sum(arrive) * started[..., None]).transpose(0, 2, 1) @ tail
        stats[:, j] = visits @ tail
        stats[:, 3 + j] = (visits * x[:, None]) @ tail
        stats[:, 6 + j] = (visits * x[:, None] ** 2) @ tail
        for i in range(STATES):
            stats[:, 9 + 3 * i + j] = (arrive[i] * moved[..., None]).transpose(0, 2, 1) @ tail
    log_scale = log_scale + lanes(top, 0.0).sum(axis=1)
    total = (weight[0], stats[0], log_scale[0])
    for lane in range(1, count):
        total = _compose(total, (weight[lane], stats[lane], log_scale[lane]))
    return total


_RUN = "chunk int, pos long, w array<double>, s array<double>, c double"
#: Stretches of consecutive rows that come to the driver one by one; more are composed in tasks first.
MAX_RUNS = 10_000


def _row(run) -> pd.DataFrame:
    w, s, c = run[3]
    return pd.DataFrame({"chunk": [run[0]], "pos": [run[1]], "w": [w.ravel()], "s": [s.ravel()], "c": [c]})


def _composed(pdf: pd.DataFrame):
    """Stretches that follow one another as one: chunk, first pos, no next pos, summary."""
    pdf, total = pdf.sort_values(["chunk", "pos"]), None
    for w, s, c in zip(pdf["w"], pdf["s"], pdf["c"]):
        part = (np.reshape(w, (STATES, STATES)), np.reshape(s, (_STATS, STATES, STATES)), c)
        total = part if total is None else _compose(total, part)
    return int(pdf["chunk"].iloc[0]), int(pdf["pos"].iloc[0]), None, total


def _has_many_runs(scores: DataFrame) -> bool:
    """Whether tasks see more than MAX_RUNS stretches of consecutive rows, as in small interleaved files."""
    def count(batches):
        n, last = 0, None
        for pdf in batches:
            pdf = pdf.sort_values(["chunk", "pos"])
            chunk, pos = pdf["chunk"].to_numpy(), pdf["pos"].to_numpy()
            n += int(((np.diff(chunk) != 0) | (np.diff(pos) != 1)).sum())
            n += len(pdf) > 0 and last != (chunk[0], pos[0] - 1)
            last = (chunk[-1], pos[-1]) if len(pdf) else last
        yield pd.DataFrame({"n": [n]})

    return scores.select("chunk", "pos").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] > MAX_RUNS


def _expectations(scores: DataFrame, model: dict, first_chunk: int, many_runs: bool = False):
    """Log likelihood and expected statistics of the whole sequence, without the states of its first row."""
    likelihood, stats = _all_expectations(scores, model, first_chunk, many_runs)
    return likelihood, stats[:18]


def _all_expectations(scores: DataFrame, model: dict, first_chunk: int, many_runs: bool = False):
    """Log likelihood and expected statistics of the whole sequence, in one pass.

    A task may see its rows in any cut and from any number of files: each batch
    is sorted by place and cut wherever a place is missing, and a stretch is
    only composed with the one that ends right before it.
    """
    def fold(batches):
        run = None  # chunk, first pos, next pos, summary
        for pdf in batches:
            pdf = pdf.sort_values(["chunk", "pos"])
            gap = (pdf["chunk"].diff() != 0) | (pdf["pos"].diff() != 1)
            for _, part in pdf.groupby(gap.cumsum(), sort=False):
                chunk_id, start = int(part["chunk"].iloc[0]), int(part["pos"].iloc[0])
                x = part["CVSS_Score"].to_numpy()
                here = _summary(x, model, chunk_id == first_chunk and start == 0)
                if run and run[0] == chunk_id and run[2] == start:
                    run = (chunk_id, run[1], start + len(x), _compose(run[3], here))
                    continue
                if run:
                    yield _row(run)
                run = (chunk_id, start, start + len(x), here)
        if run:
            yield _row(run)

    runs = scores.mapInPandas(fold, _RUN)
    if many_runs:
        # Neighbours are composed in groups of bounded size, then each chunk's, so a row a chunk is left.
        for key in (["chunk", F.shiftright("pos", 13).alias("range")], ["chunk"]):
            runs = runs.groupBy(*key).applyInPandas(lambda pdf: _row(_composed(pdf)), _RUN)
    total = _composed(runs.toPandas())[3]
    # Any state before the first row gives the same start.
    mass = total[0][0].sum()
    return np.log(mass) + total[2], total[1][:, 0].sum(axis=1) / mass


#: Distinct scores whose counts come to the driver.
MAX_SCORES = 100_000


def start_model(scores: DataFrame) -> dict:
    """Means at the middle of each third of the scores, common variance, even transitions."""
    # Exact quantiles from the counts per score, of which there are about a hundred; of very many, by Spark's own sketch.
    rows = scores.groupBy("CVSS_Score").count().limit(MAX_SCORES + 1).collect()
    if len(rows) <= MAX_SCORES:
        values, weights = np.array(sorted((r["CVSS_Score"], r["count"]) for r in rows), float).T
        variance = float(np.average((values - np.average(values, weights=weights)) ** 2, weights=weights))
        reached = np.cumsum(weights) / weights.sum()
        means = [float(values[np.searchsorted(reached, q - 1e-12)]) for q in (1 / 6, 1 / 2, 5 / 6)]
    else:
        found = scores.agg(F.percentile_approx("CVSS_Score", [1 / 6, 1 / 2, 5 / 6], 100_000).alias("q"),
                           F.var_pop("CVSS_Score").alias("v")).first()
        variance, means = found.v, list(found.q)
    spread = max(np.sqrt(variance), 0.1)
    if len(set(means)) < STATES:  # few distinct scores: keep the states apart
        means = [means[1] - spread, means[1], means[1] + spread]
    even = [1 / STATES] * STATES
    return {"means": means, "variances": [variance + VARIANCE_PRIOR] * STATES,
            "transmat": [even] * STATES, "startprob": even}


def fit(rows: DataFrame, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> dict:
    """Fitted model, states ordered by mean, with the log likelihood of every iteration.

    `rows` come from sequence.ordered_rows.
    """
    scores = rows.select("chunk", "pos", "CVSS_Score").persist()
    try:
        first_chunk = scores.agg(F.min("chunk")).first()[0]
        model = start_model(scores)
        history, many_runs = [], _has_many_runs(scores)
        for _ in range(max_iterations):
            likelihood, stats = _all_expectations(scores, model, first_chunk, many_runs)
            history.append(float(likelihood))
            if len(history) > 1 and history[-1] - history[-2] < tolerance:
                break
            model = _maximise(stats)
        return ordered_by_mean({**model, "log_likelihood": history})
    finally:
        scores.unpersist()


def em_step(rows: DataFrame, model: dict) -> dict:
    """The model after one Baum-Welch step, with the log likelihood of the one before."""
    first_chunk = rows.agg(F.min("chunk")).first()[0]
    scores = rows.select("chunk", "pos", "CVSS_Score")
    likelihood, stats = _all_expectations(scores, model, first_chunk, _has_many_runs(scores))
    return {**_maximise(stats), "log_likelihood": [float(likelihood)]}


def _maximise(stats: np.ndarray) -> dict:
    count, total, squares = stats[0:3], stats[3:6], stats[6:9]
    moves, start = stats[9:18].reshape(STATES, STATES), stats[18:]
    means = total / np.maximum(count, 1e-300)
    variances = (VARIANCE_PRIOR + np.maximum(squares - count * means ** 2, 0)) / np.maximum(count, 1e-5)
    left = moves.sum(axis=1, keepdims=True)
    transmat = np.where(left > 0, moves / np.where(left > 0, left, 1), 1 / STATES)
    return {"means": means.tolist(), "variances": variances.tolist(), "transmat": transmat.tolist(),
            "startprob": (start / start.sum()).tolist()}


def ordered_by_mean(model: dict) -> dict:
    """The same model with Low, Medium, High in ascending order of mean."""
    order = np.argsort(model["means"])
    return {
        **model,
        "means": np.array(model["means"])[order].tolist(),
        "variances": np.array(model["variances"])[order].tolist(),
        "std_devs": np.sqrt(np.array(model["variances"])[order]).tolist(),
        "transmat": np.array(model["transmat"])[order][:, order].tolist(),
        "startprob": np.array(model["startprob"])[order].tolist(),
    }


def path_steps(model: dict) -> chain.Steps:
    """Scores of moving between the states at each row, for the best path."""
    def steps(x: np.ndarray, first: bool) -> np.ndarray:
        with np.errstate(divide="ignore"):
            log_b = _log_density(x, model)
            moves = np.log(np.array(model["transmat"]))[None] + log_b[:, None, :]
            if first:
                moves[0] = np.log(np.array(model["startprob"])) + log_b[0]
        return moves

    return steps


def decode(rows: DataFrame, model: dict, segment: int = chain.SEGMENT) -> DataFrame:
    """Most likely state path (Viterbi) of the whole sequence, exact for any cut."""
    return chain.decode(rows, path_steps(model), segment)


def timeline(decoded: DataFrame) -> DataFrame:
    return decoded.select(F.col("CVE_ID").alias("cve_id"), F.col("CVSS_Score").alias("cvss"),
                          F.col("Year").alias("year"), "state")


def model_table(spark, model: dict) -> DataFrame:
    """The model as one row: means, std_devs, transmat."""
    return spark.createDataFrame(
        [(model["means"], model["std_devs"], model["transmat"])],
        "means array<double>, std_devs array<double>, transmat array<array<double>>")


def order_states(models: DataFrame) -> DataFrame:
    """Models with means, standard deviations and both matrix axes in ascending order of mean."""
    tagged = F.transform("means", lambda m, i: F.struct(m.alias("mean"), i.alias("i")))
    order = F.transform(F.array_sort(tagged), lambda s: s["i"])

    def pick(array):
        return F.transform("order", lambda i: F.get(array, i))

    rows = F.transform("order", lambda i: F.transform("order", lambda j: F.get(F.get("transmat", i), j)))
    return models.withColumn("order", order).withColumns({
        "means": pick("means"), "std_devs": pick("std_devs"), "transmat": rows})


def with_next_state(models: DataFrame, current: Column) -> DataFrame:
    """Ordered models with the most likely next state, its probability and its mean,
    for the index of the current state."""
    here = models.withColumn("_current", current)
    row = F.get("transmat", F.col("_current"))
    best = first_argmax(row)
    names = F.array(*[F.lit(s) for s in fx.THREAT_STATES])
    return here.withColumns({
        "current_state": F.get(names, F.col("_current")),
        "predicted_next_state": F.get(names, best),
        "probability": F.get(row, best),
        "expected_next_cvss": F.get("means", best),
    }).drop("_current")


def analysis(rows: DataFrame, model: dict) -> DataFrame:
    """One row: current state, last score and the outlook for the next record."""
    decoded = decode(rows, model)
    last = decoded.agg(F.max_by(F.struct("CVSS_Score", "state"), F.struct("chunk", "pos")).alias("last"))
    names = F.array(*[F.lit(s) for s in fx.THREAT_STATES])
    current = last.select((F.array_position(names, F.col("last.state")) - 1).cast("int"))
    outlook = with_next_state(model_table(rows.sparkSession, model), current.scalar())
    return outlook.select("current_state", "predicted_next_state", "probability", "expected_next_cvss").withColumn(
        "last_cvss", last.select("last.CVSS_Score").scalar())
