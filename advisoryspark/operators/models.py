"""Score regression, out-of-fold predictions, text classification, saved models."""

import json
import os
import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.operators import evaluation, hmm, memm, sequence, tfidf
from advisoryspark.operators.trees import ForestModel, TreeTaskForestRegressor
from advisoryspark.session import materialize, scratch

MIN_ROWS = 10

# Model parameters of the forest, the same for every table.  A tree has at most
# 2**MAX_DEPTH leaves, which bounds the model on the driver; a feature is split at
# quantiles of its values, MAX_BINS of them, where an exact search would try each value.
MAX_DEPTH, MAX_BINS = 12, 32


def check_enough(records: DataFrame, at_least: int = MIN_ROWS) -> None:
    """Raise unless the table holds the rows a model needs; reads at most that many."""
    if records.limit(at_least).count() < at_least:
        raise ValueError(f"need at least {at_least} records")


def forest(trees: int, max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS, seed: int = 42,
           kind: type[RandomForestRegressor] = RandomForestRegressor) -> RandomForestRegressor:
    """Forest with all features at every split.

    Split statistics are kept per node, feature and bin, and dominate the cost
    of deep trees.  A task holds those of one group of nodes, MLlib's default of
    256 MB; a level with more nodes takes more passes.
    """
    return kind(
        labelCol="CVSS_Score", featuresCol="features", predictionCol="predicted",
        numTrees=trees, maxDepth=max_depth, maxBins=max_bins, featureSubsetStrategy="all", seed=seed,
        cacheNodeIds=True)


def grow(vectors: DataFrame, trees: int, max_depth: int, max_bins: int,
         kind: type[RandomForestRegressor] = RandomForestRegressor) -> RandomForestRegressionModel | ForestModel:
    """A forest fitted on the vectors, read in no more tasks than the cluster runs at a time.

    Every task sends the statistics of every node, so their volume follows the tasks, not the rows.
    """
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    return forest(trees, max_depth, max_bins, kind=kind).fit(vectors.select("CVSS_Score", "features").coalesce(tasks))


def fit_score_model(records: DataFrame, trees: int = 50, max_depth: int = MAX_DEPTH,
                    max_bins: int = MAX_BINS) -> PipelineModel:
    """Text to score: TF-IDF stages followed by the forest, one saveable pipeline.

    The vectors are written for the fit; growing the trees reads them again per level.
    """
    check_enough(records)
    weighting = tfidf.fit(records)
    with scratch(tfidf.features(weighting, records).select("CVSS_Score", "features"), "vectors") as vectors:
        trained = grow(vectors, trees, max_depth, max_bins)
    return PipelineModel([*weighting.stages, trained])


def predict_scores(records: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Records with the predicted score, rounded to one digit; a constant without a model."""
    if model is None:
        return records.withColumn("predicted", F.lit(fx.FALLBACK_PREDICTED_SCORE))
    return tfidf.features(model, records).drop("features").withColumn("predicted", F.round("predicted", 1))


def score_errors(records: DataFrame, model: PipelineModel) -> DataFrame:
    """MAE and RMSE of the unrounded predictions on the given rows."""
    return evaluation.regression_errors(model.transform(records), "CVSS_Score", "predicted")


def fold_numbers(records: DataFrame, folds: int = 3) -> DataFrame:
    """CVE_ID and fold: contiguous stretches of the chronological order, the first ones a
    row longer when the count does not divide; with fewer rows than folds all are in fold 0.

    Only ids and years are sorted.
    """
    n = records.count()
    if n < folds:
        return records.select("CVE_ID", F.lit(0).alias("fold"))
    size, extra = divmod(n, folds)
    index = F.col("position") - 1
    longer = extra * (size + 1)
    fold = F.when(index < longer, F.floor(index / (size + 1))).otherwise(
        extra + F.floor((index - longer) / size)).cast("int")
    placed = sequence.with_position(sequence.ordered_rows(records, columns=("CVE_ID", "Year")))
    return placed.select("CVE_ID", fold.alias("fold"))


def out_of_fold(records: DataFrame, folds: int = 3, trees: int = 100, max_depth: int = MAX_DEPTH,
                max_bins: int = MAX_BINS) -> DataFrame:
    """CVE_ID, CVSS_Score, fold and the prediction of a forest that did not see the row.

    Fewer rows than folds fall back to one fit on everything.  The TF-IDF stages
    are fitted on all rows.  The forests are not kept, so their trees are grown
    in tasks of their own instead of MLlib's.
    """
    weighting = tfidf.fit(records)
    vectors = tfidf.features(weighting, records).select("CVE_ID", "CVSS_Score", "features")
    # By the size of its compressed file the planner would broadcast a table with a row for each record.
    rows = materialize(vectors.join(fold_numbers(records, folds).hint("merge"), "CVE_ID"), "folds")
    if records.limit(folds).count() < folds:
        model = grow(rows, trees, max_depth, max_bins, TreeTaskForestRegressor)
        return model.transform(rows).select("CVE_ID", "CVSS_Score", "fold", "predicted")

    def held_out(k: int) -> DataFrame:
        model = grow(rows.filter(F.col("fold") != k), trees, max_depth, max_bins, TreeTaskForestRegressor)
        return model.transform(rows.filter(F.col("fold") == k)).select(
            "CVE_ID", "CVSS_Score", "fold", "predicted")

    # The fits share the cluster; what a task holds does not depend on their number.
    with ThreadPool(folds) as pool:
        return reduce(DataFrame.unionByName, pool.map(held_out, range(folds)))


def fit_text_classifier(labelled: DataFrame, label: str, size: int = 2000) -> PipelineModel:
    """Description to category: TF-IDF and multinomial logistic regression.

    `size` is a parameter of the model: its features are the `size` most frequent
    terms of the labelled texts, and rarer terms have no weight.
    """
    weighting = tfidf.fit(labelled, size)
    regression = LogisticRegression(labelCol="_label", family="multinomial", regParam=0.001, maxIter=50, tol=1e-4)
    with scratch(tfidf.features(weighting, labelled).select(
            F.col(label).cast("string").alias(label), "features"), "labelled") as vectors:
        indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(vectors)
        trained = regression.fit(indexer.transform(vectors))
    names = IndexToString(inputCol="prediction", outputCol="category", labels=indexer.labels)
    return PipelineModel([*weighting.stages, trained, names])


def classify(records: DataFrame, model: PipelineModel) -> DataFrame:
    """Records with the category and the probability of it, three digits.

    A model that gives no probability vector gives `category_confidence` itself.
    """
    scored = tfidf.features(model, records)
    if "probability" in scored.columns:
        scored = scored.withColumn("category_confidence", F.round(F.array_max(vector_to_array("probability")), 3))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


# --- all models together ---------------------------------------------------------

METRICS = "rf_mae double, rf_rmse double, hmm_means array<double>, hmm_transition_mat array<array<double>>, memm_accuracy double"


def train_all(records: DataFrame, trees: int = 50, max_depth: int = MAX_DEPTH) -> dict:
    """Fit every model on the table: score pipeline, HMM, MEMM and a one-row metrics frame."""
    check_enough(records)
    score_model = fit_score_model(records, trees, max_depth)
    errors = score_errors(records, score_model).first()
    rows = sequence.ordered_rows(records, columns=("CVE_ID", "Year", "CVSS_Score"))
    hidden = hmm.fit(rows)
    maxent = memm.fit(rows)
    accuracy = memm.training_accuracy(rows, maxent).first()["accuracy"]
    metrics = records.sparkSession.createDataFrame(
        [(errors["mae"], errors["rmse"], hidden["means"], hidden["transmat"], accuracy)], METRICS)
    return {"score": score_model, "hmm": hidden, "memm": maxent, "metrics": metrics}


def save(models: dict, path: str) -> None:
    """Write the set into a folder of its own and then publish it by one new pointer file.

    A crash leaves the set published before; readers never see parts of two sets.
    """
    spark = models["metrics"].sparkSession
    published = _published(spark, path)
    version = f"{(int(published.split('-')[0]) if published else 0) + 1:06d}-{uuid.uuid4().hex}"
    own = os.path.join(path, "sets", version)
    models["score"].write().save(os.path.join(own, "score"))
    models["memm"].write().save(os.path.join(own, "memm"))
    hidden = spark.createDataFrame([(json.dumps(models["hmm"]),)], "parameters string")
    hidden.coalesce(1).write.json(os.path.join(own, "hmm"))
    models["metrics"].coalesce(1).write.json(os.path.join(own, "metrics"))
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(
        os.path.join(path, "published"))


def _published(spark: SparkSession, path: str) -> str | None:
    """Name of the newest published set; the number in front grows with every save."""
    try:
        return spark.read.schema("version string").json(os.path.join(path, "published")).agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load(spark: SparkSession, path: str) -> dict | None:
    """The set published last, or None if there is none."""
    version = _published(spark, path)
    if version is None:
        return None
    own = os.path.join(path, "sets", version)
    hidden = spark.read.schema("parameters string").json(os.path.join(own, "hmm")).first()
    return {
        "score": PipelineModel.load(os.path.join(own, "score")),
        "memm": LogisticRegressionModel.load(os.path.join(own, "memm")),
        "hmm": json.loads(hidden["parameters"]),
        "metrics": spark.read.schema(METRICS).json(os.path.join(own, "metrics")),
    }


def load_or_train(records: DataFrame, path: str, **options) -> dict:
    found = load(records.sparkSession, path)
    if found is None:
        found = train_all(records, **options)
        save(found, path)
    return found
