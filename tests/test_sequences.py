"""Chunked sequence models against plain sequential algorithms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions.scores import threat_state
from advisoryspark.operators import chain, hmm, memm, sequence

MODEL = {
    "means": [2.0, 5.0, 8.0], "variances": [1.5, 1.0, 0.7],
    "transmat": [[0.7, 0.2, 0.1], [0.2, 0.5, 0.3], [0.05, 0.35, 0.6]], "startprob": [0.2, 0.5, 0.3],
}


@pytest.fixture()
def rows(spark, many_chunks):
    rng = np.random.default_rng(11)
    state, scores = 0, []
    for _ in range(4000):
        state = rng.choice(3, p=MODEL["transmat"][state])
        scores.append(float(np.clip(rng.normal(MODEL["means"][state], 1.0), 0, 10)))
    data = [(f"CVE-{i:06d}", "2019" if i < 1400 else str(2020 + i // 1000), s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(data, "CVE_ID string, Year string, CVSS_Score double").repartition(5)
    placed = sequence.ordered_rows(df)
    assert placed.select("chunk").distinct().count() > 3
    return placed, np.array(scores)


def viterbi(x, model):
    log_b = hmm._log_density(x, model)
    reach, back = np.log(model["startprob"]) + log_b[0], []
    for t in range(1, len(x)):
        options = reach[:, None] + np.log(model["transmat"]) + log_b[t]
        back.append(options.argmax(axis=0))
        reach = options.max(axis=0)
    path = [int(reach.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def forward_backward(x, model):
    b, a = np.exp(hmm._log_density(x, model)), np.array(model["transmat"])
    alpha, scale = np.zeros((len(x), 3)), np.zeros(len(x))
    for t in range(len(x)):
        alpha[t] = (np.array(model["startprob"]) if t == 0 else alpha[t - 1] @ a) * b[t]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    beta = np.ones((len(x), 3))
    for t in range(len(x) - 2, -1, -1):
        beta[t] = a @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    xi = sum(alpha[t][:, None] * a * (b[t + 1] * beta[t + 1]) / scale[t + 1] for t in range(len(x) - 1))
    stats = np.concatenate([gamma.sum(0), (gamma * x[:, None]).sum(0), (gamma * x[:, None] ** 2).sum(0), xi.ravel()])
    return np.log(scale).sum(), stats


@pytest.mark.parametrize("segment", [37, 500, 100_000])
def test_viterbi_equals_sequential(rows, segment):
    placed, scores = rows
    got = [r.state for r in hmm.decode(placed, MODEL, segment).orderBy("Year", "CVE_ID").collect()]
    assert got == [fx.THREAT_STATES[s] for s in viterbi(scores, MODEL)]


def test_expected_statistics_equal_forward_backward(rows):
    placed, scores = rows
    first = placed.agg(F.min("chunk")).first()[0]
    likelihood, stats = hmm._expectations(placed.select("chunk", "pos", "CVSS_Score"), MODEL, first)
    expected_likelihood, expected = forward_backward(scores, MODEL)
    assert likelihood == pytest.approx(expected_likelihood, rel=1e-9)
    assert np.allclose(stats, expected, rtol=1e-8)


def test_start_of_rare_first_states_is_not_a_difference_of_counts(rows):
    placed, scores = rows
    model = {**MODEL, "startprob": [1e-11, 1 - 3e-11, 2e-11]}
    b, a, beta = np.exp(hmm._log_density(scores, model)), np.array(model["transmat"]), np.ones(3)
    for t in range(len(scores) - 1, 0, -1):
        beta = a @ (b[t] * beta)
        beta /= beta.sum()
    want = np.array(model["startprob"]) * b[0] * beta
    assert min(want / want.sum()) < 1e-9
    assert hmm.em_step(placed, model)["startprob"] == pytest.approx((want / want.sum()).tolist(), rel=1e-9, abs=0)


@pytest.mark.parametrize("arrow", ["false", "true"])
def test_any_file_layout_gives_the_same_statistics(spark, rows, tmp_path, arrow):
    placed, scores = rows
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "29")
    try:
        path = str(tmp_path / "many")
        placed.write.option("maxRecordsPerFile", 37).parquet(path)
        scattered = spark.read.parquet(path)
        first = placed.agg(F.min("chunk")).first()[0]
        likelihood, stats = hmm._expectations(scattered.select("chunk", "pos", "CVSS_Score"), MODEL, first)
    finally:
        for key in ("spark.sql.execution.arrow.pyspark.enabled", "spark.sql.files.maxPartitionBytes",
                    "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(key)
    expected_likelihood, expected = forward_backward(scores, MODEL)
    assert likelihood == pytest.approx(expected_likelihood, rel=1e-9) and np.allclose(stats, expected, rtol=1e-8)


def test_fit_improves_and_is_ordered(rows):
    placed, _ = rows
    model = hmm.fit(placed, max_iterations=12)
    history = model["log_likelihood"]
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    assert model["means"] == sorted(model["means"])
    assert np.allclose(np.sum(model["transmat"], axis=1), 1) and np.isclose(sum(model["startprob"]), 1)
    table = hmm.model_table(placed.sparkSession, model)
    outlook = hmm.analysis(placed, model).first()
    last = hmm.decode(placed, model).orderBy(F.desc("chunk"), F.desc("pos")).first()
    row = model["transmat"][fx.THREAT_STATES.index(last.state)]
    assert outlook.current_state == last.state and outlook.last_cvss == last.CVSS_Score
    assert outlook.predicted_next_state == fx.THREAT_STATES[int(np.argmax(row))]
    assert outlook.probability == pytest.approx(max(row)) and table.count() == 1


def test_order_states(spark):
    model = spark.createDataFrame(
        [([8.0, 2.0, 5.0], [0.8, 0.2, 0.5], [[.6, .1, .3], [.2, .7, .1], [.25, .35, .4]])],
        "means array<double>, std_devs array<double>, transmat array<array<double>>")
    row = hmm.order_states(model).first()
    assert row.order == [1, 2, 0] and row.means == [2.0, 5.0, 8.0] and row.std_devs == [0.2, 0.5, 0.8]
    assert row.transmat == [[.7, .1, .2], [.35, .4, .25], [.1, .3, .6]]


def test_memm_decode_equals_row_by_row(rows):
    placed, scores = rows
    model = memm.fit(placed)
    weights, bias = memm.parameters(model)
    state = int(np.digitize(scores[0], [4.0, 7.0]))
    expected = [state]
    for s in scores[1:]:
        state = int((weights[:, 0] * s + weights[:, 1 + state] + bias).argmax())
        expected.append(state)
    decoded = memm.decode(placed, weights, bias)
    got = [r.state for r in decoded.orderBy("Year", "CVE_ID").collect()]
    assert got == [fx.THREAT_STATES[s] for s in expected]
    step = memm.what_if(decoded, model, 8.5).first()
    assert step.current_state == got[-1] and step.simulated_cvss == 8.5
    true = [fx.THREAT_STATES[s] for s in np.digitize(scores, [4.0, 7.0])]
    assert step.accuracy == pytest.approx(np.mean([a == b for a, b in zip(got, true)]))
    assert sum(step.probabilities.values()) == pytest.approx(1.0)
    assert step.predicted_next_state == max(step.probabilities, key=step.probabilities.get)
    assert memm.training_accuracy(placed, model).first().accuracy > 0.95


def test_memm_equals_penalised_likelihood(rows):
    """The fit minimises the summed loss plus half the squared weights."""
    placed, scores = rows
    model = memm.fit(placed)
    weights, bias = memm.parameters(model)
    states = np.digitize(scores, [4.0, 7.0])
    x = np.concatenate([scores[1:, None], np.eye(3)[states[:-1]]], axis=1)
    logits = x @ weights.T + bias
    chance = np.exp(logits - logits.max(1, keepdims=True))
    chance /= chance.sum(1, keepdims=True)
    gradient = (chance - np.eye(3)[states[1:]]).T @ x + weights
    assert np.abs(gradient).max() < 0.02


def test_previous_state_crosses_chunks(rows):
    placed, scores = rows
    states = [fx.THREAT_STATES[i] for i in np.digitize(scores, [4.0, 7.0])]
    for segment in (7, 500, sequence.SEGMENT):
        got = sequence.with_previous(placed.withColumn("state", threat_state(F.col("CVSS_Score"))), "state", "prev", segment)
        assert [r.prev for r in got.orderBy("Year", "CVE_ID").collect()] == [None] + states[:-1]


def test_short_sequences(spark):
    for n in (1, 2, 3):
        df = spark.createDataFrame([(f"CVE-{i}", "2020", float(3 * i)) for i in range(n)],
                                   "CVE_ID string, Year string, CVSS_Score double")
        placed = sequence.ordered_rows(df)
        got = [r.state for r in hmm.decode(placed, MODEL).orderBy("CVE_ID").collect()]
        assert got == [fx.THREAT_STATES[s] for s in viterbi(np.array([3.0 * i for i in range(n)]), MODEL)]


def test_lane_product_equals_loop():
    rng = np.random.default_rng(5)
    steps = rng.normal(size=(101, 3, 3))
    total = steps[0]
    for m in steps[1:]:
        total = (total[:, :, None] + m[None]).max(axis=1)
    assert np.allclose(chain.product(steps), total)
