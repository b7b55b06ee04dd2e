"""Text features, score model, folds, classifier and the saved model set."""

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from advisoryspark.functions.scores import severity
from advisoryspark.operators import evaluation, inference, models, tfidf
from advisoryspark.plans import reports
from advisoryspark.plans.enrich import enrich
from advisoryspark.sources import tables
from advisoryspark.sources.testview import raw_records

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def records(spark, small):
    return enrich(raw_records(spark, small)).persist()


@pytest.fixture(scope="module")
def trained(records):
    return models.train_all(records, trees=5, max_depth=8)


def test_weights_by_hand(spark):
    docs = spark.createDataFrame([("1", "Cat cat dog! a"), ("2", "dog bird"), ("3", "")], "CVE_ID string, Description string")
    got = {(r.CVE_ID, r.term): r.weight for r in tfidf.weights(tfidf.fit(docs, 2), docs).collect()}
    cat, dog = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    length = math.hypot(2 * cat, dog)
    assert got == {("1", "cat"): pytest.approx(2 * cat / length), ("1", "dog"): pytest.approx(dog / length),
                   ("2", "dog"): pytest.approx(1.0)}


def test_features_need_no_shuffle(records):
    weighting = tfidf.fit(records)
    plan = tfidf.features(weighting, records)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_score_model_beats_the_mean(records, trained):
    errors = models.score_errors(records, trained["score"]).first()
    mean = records.agg(F.avg("CVSS_Score")).first()[0]
    flat = evaluation.regression_errors(records.withColumn("m", F.lit(mean)), "CVSS_Score", "m").first()
    assert errors.mae <= flat.mae and errors.rmse <= flat.rmse and errors.n == records.count()
    scored = models.predict_scores(records, trained["score"])
    assert scored.filter(F.round("predicted", 1) != F.col("predicted")).isEmpty()


def test_fallback_without_model(records):
    assert {r.predicted for r in models.predict_scores(records, None).select("predicted").distinct().collect()} == {5.0}


def test_out_of_fold_covers_each_row_once(records, many_chunks):
    rows = models.out_of_fold(records, trees=2, max_depth=3).collect()
    assert len(rows) == len({r.CVE_ID for r in rows}) == 200
    sizes = [sum(r.fold == k for r in rows) for k in range(3)]
    assert sizes == [67, 67, 66]
    order = [r.fold for r in sorted(rows, key=lambda r: (r.CVE_ID.split("-")[1], r.CVE_ID))]
    assert order == sorted(order)
    assert models.out_of_fold(records.limit(2), trees=2, max_depth=3).count() == 2


def test_fits_are_bounded_in_memory_and_tasks(spark, records, many_chunks, monkeypatch):
    fit, seen = models.RandomForestRegressor.fit, []

    def watched(self, rows, *more):
        seen.append((rows.rdd.getNumPartitions(), self.getMaxMemoryInMB()))
        return fit(self, rows, *more)

    monkeypatch.setattr(models.RandomForestRegressor, "fit", watched)
    monkeypatch.setattr(models, "materialize", lambda df, name: df.repartition(40))
    assert models.out_of_fold(records, trees=2, max_depth=3).count() == records.count()
    assert len(seen) == 3
    assert max(parts for parts, _ in seen) <= spark.sparkContext.defaultParallelism
    assert max(mb for _, mb in seen) <= 256


def test_settings_do_not_follow_the_size():
    assert models.forest(3).getMaxDepth() == models.MAX_DEPTH and models.forest(3).getMaxBins() == models.MAX_BINS
    import inspect
    assert "rows" not in inspect.signature(models.forest).parameters


def test_saved_set_is_complete_or_absent(spark, records, trained, tmp_path):
    path = str(tmp_path / "models")
    assert models.load(spark, path) is None
    models.save(trained, path)
    loaded = models.load_or_train(records, path)
    before = models.predict_scores(records, trained["score"]).select("CVE_ID", "predicted")
    after = models.predict_scores(records, loaded["score"]).select("CVE_ID", "predicted")
    assert before.exceptAll(after).isEmpty()
    assert loaded["hmm"]["means"] == trained["hmm"]["means"]
    assert loaded["metrics"].first() == trained["metrics"].first()
    other = {**trained, "hmm": {**trained["hmm"], "means": [1.0, 2.0, 3.0]}}
    models.save(other, path)
    assert models.load(spark, path)["hmm"]["means"] == [1.0, 2.0, 3.0]
    partial = str(tmp_path / "partial")
    trained["score"].write().save(partial + "/sets/000001-x/score")
    assert models.load(spark, partial) is None


def test_metrics_row_feeds_the_status(records, trained):
    metrics = trained["metrics"].first()
    assert metrics.hmm_means == sorted(metrics.hmm_means) and 0.9 < metrics.memm_accuracy <= 1
    from advisoryspark.operators.aggregates import status_report
    rows = status_report(records, trained["metrics"]).collect()
    total = next(r for r in rows if r.dimension == "total")
    assert total.n == 200 and total.rf_mae == pytest.approx(metrics.rf_mae, abs=6e-4)
    assert total.memm_accuracy == pytest.approx(100 * metrics.memm_accuracy, abs=0.06)


def test_too_few_rows_are_refused(spark):
    with pytest.raises(ValueError):
        models.train_all(tables.seed_records(spark).limit(9))


def test_text_classifier(spark):
    rows = [("alpha beta words here", "x"), ("alpha beta other thing", "x"),
            ("gamma delta words here", "y"), ("gamma delta other thing", "y")] * 20
    df = spark.createDataFrame(rows, "Description string, label string")
    model = models.fit_text_classifier(df, "label")
    assert isinstance(model, PipelineModel)
    got = models.classify(df, model).collect()
    assert all(r.category == r.label and 0.5 < r.category_confidence <= 1 for r in got)
    pairs = models.classify(df, model)
    assert evaluation.accuracy(pairs, "label", "category").first().accuracy == 1.0


def length_model():
    def predict(texts):
        for t in texts:
            if "boom" in t:
                raise RuntimeError("broken")
        return [("long" if len(t) > 10 else "short", len(t) / 3) for t in texts]
    return predict


def share_model():
    def predict(texts, labels):
        if any("boom" in t for t in texts):
            raise RuntimeError("broken")
        return [[0.1, 0.7, 0.7, 0.2] for _ in texts]
    return predict


def test_batches_by_length(spark):
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(0, 50, 200), [5000, 700]])
    batches = list(inference.by_length(lengths, 1000))
    assert sorted(np.concatenate(batches).tolist()) == list(range(202))
    assert all(len(b) * lengths[b].max() <= 1000 or len(b) == 1 for b in batches)
    assert len(batches) < 15 and list(inference.by_length(lengths[:0], 10)) == []
    rows = [(i, None if i == 3 else " ".join(["w"] * int(n)) + ("" if i % 7 else " bad")) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(2)

    def model():
        def predict(texts):
            assert len(texts) * max(len(t.split()) for t in texts) <= 1100 or len(texts) == 1
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [(f"n{len(t.split())}", 1 / 3) for t in texts]
        return predict

    got = {r.i: (r.p.label, r.p.score) for r in df.select("i", inference.predict_by_length(F.col("t"), model, 1000).alias("p")).collect()}
    assert got == {i: ("UNKNOWN", 0.0) if "bad" in (t or "") else (f"n{len((t or '').split())}", 0.333) for i, t in rows}


def test_category_inference_isolates_failures(spark):
    texts = [f"text number {i}" if i % 3 else f"t{i}" for i in range(50)] + ["boom"]
    df = spark.createDataFrame([(t,) for t in texts], "Description string")
    got = {r.Description: r.p for r in df.select(
        "Description", inference.predict_category(F.col("Description"), length_model).alias("p")).collect()}
    assert tuple(got["boom"]) == ("UNKNOWN", 0.0)
    for t in texts[:-1]:
        assert tuple(got[t]) == ("long" if len(t) > 10 else "short", round(len(t) / 3, 3))
    failed = df.select(inference.predict_category(F.col("Description"), length_model, error_label="ERROR").alias("p"))
    assert failed.filter("p.label = 'ERROR'").count() == 1


def test_zero_shot_takes_first_best_label(spark):
    df = spark.createDataFrame([("fine",), ("boom",)], "Description string")
    got = {r.Description: (r.zero_shot_severity, r.zero_shot_confidence)
           for r in inference.zero_shot_severity(df, share_model).collect()}
    assert got == {"fine": ("HIGH", 0.7), "boom": ("UNKNOWN", 0.0)}


def test_record_report(spark, trained):
    seeds = models.predict_scores(tables.seed_records(spark), trained["score"])
    row = reports.record_report(
        seeds, "cve-2021-44228", F.col("predicted"),
        inference.predict_category(F.col("Description"), length_model),
        inference.top_label(inference.label_scores(F.col("Description"), share_model, ["a", "b", "c", "d"]),
                            ["a severity", "b severity", "c severity", "d severity"])).first()
    assert row.cve_id == "CVE-2021-44228" and row.bert_category == "long" and row.zero_shot_severity == "B"
    expected = spark.range(1).select(severity(F.lit(row.rf_predicted_cvss))).first()[0]
    assert row.rf_predicted_severity == expected


def test_class_report_by_hand(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "b")]
    df = spark.createDataFrame(pairs, "y string, p string")
    rows = {r.label: r for r in evaluation.class_report(df, "y", "p").collect()}
    assert tuple(rows["a"])[1:] == (1.0, 0.75, pytest.approx(6 / 7, abs=1e-6), 4)
    assert tuple(rows["b"])[1:] == (0.5, 1.0, pytest.approx(2 / 3, abs=1e-6), 2)
    assert tuple(rows["c"])[1:] == (0.0, 0.0, 0.0, 1)
    assert rows["accuracy"].f1 == pytest.approx(5 / 7, abs=1e-6)
    assert rows["macro avg"].recall == pytest.approx(1.75 / 3, abs=1e-6)
    assert rows["weighted avg"].precision == pytest.approx((4 + 1) / 7, abs=1e-6)
