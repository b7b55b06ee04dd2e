"""The forest whose trees are grown one in a task."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import types as T

from advisoryspark.operators import models, trees
from advisoryspark.plans.enrich import enrich
from advisoryspark.sources.testview import raw_records

SCHEMA = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("x", VectorUDT())])


@pytest.fixture(scope="module")
def records(spark, small):
    return enrich(raw_records(spark, small)).persist()


def values(n, seed=3):
    """Sparse features; one of few values, one below and above zero, one without any."""
    random = np.random.default_rng(seed)
    x = np.where(random.random((n, 6)) < 0.5, 0, random.random((n, 6)))
    x[:, 1], x[:, 2], x[:, 3] = random.integers(0, 4, n), random.normal(size=n), 0
    return x, 3 * x[:, 0] + x[:, 1] * x[:, 2] + random.normal(size=n)


def table(spark, x, y):
    return spark.createDataFrame([(None if v is None else float(v), Vectors.dense(row)) for row, v in zip(x, y)], SCHEMA).repartition(3)


def fitted(kind, df, **more):
    return kind(labelCol="y", featuresCol="x", predictionCol="p", featureSubsetStrategy="all", **more).fit(df)


def local_rows(x, y, bins, size):
    code, kind = trees._coder(bins)
    batches = [pa.RecordBatch.from_arrays([pa.array(y[i:i + size]), pa.array(x[i:i + size].tolist())], ["label", "features"])
               for i in range(0, len(y), size)]
    return trees._blocks(code(batches), kind, 0.0, 2.0 ** 30)


def local_bins(x, splits=31):
    points = [trees.split_points(column, splits) for column in x.T]
    return trees.Bins(points, np.array([np.searchsorted(p, 0.0) for p in points]), max(map(len, points)) + 1)


@pytest.mark.parametrize("depth, bins", [(12, 32), (4, 8), (1, 32)])
def test_without_draws_the_trees_are_mllibs(spark, depth, bins):
    df = table(spark, *values(400)).persist()
    settings = {"numTrees": 2, "maxDepth": depth, "maxBins": bins, "bootstrap": False, "seed": 1}
    expected = {(r.y, tuple(r.x)): r.p for r in fitted(RandomForestRegressor, df, **settings).transform(df).collect()}
    got = {(r.y, tuple(r.x)): r.p for r in fitted(trees.TreeTaskForestRegressor, df, **settings).transform(df).collect()}
    assert len(got) == 400 and got == pytest.approx(expected, abs=1e-6)


def test_blocks_do_not_change_a_tree(monkeypatch):
    x, y = values(3000)
    bins = local_bins(x)
    whole = trees.grow_tree(trees.Rows(trees._drawn(trees.Rows(local_rows(x, y, bins, 3000)), 7, 0)), bins, 9)
    monkeypatch.setattr(trees, "MOST", 200)
    base = trees.Rows(local_rows(x, y, bins, 37))
    assert base.file is not None and base.held <= 200
    pieces = trees.grow_tree(trees.Rows(trees._drawn(base, 7, 0)), bins, 9)
    assert len(whole[0]) > 300 and all((a == b).all() for a, b in zip(whole, pieces))


def test_split_by_hand():
    x = np.array([[0.0, 5.0], [0.0, 1.0], [2.0, 5.0], [3.0, 1.0]])
    y = np.array([1.0, 1.0, 4.0, 6.0])
    bins = local_bins(x)
    feature, last, child, value = trees.grow_tree(trees.Rows(local_rows(x, y, bins, 4)), bins, 5)
    assert [p.tolist() for p in bins.points] == [[1.0, 2.5], [3.0]]
    assert feature.tolist()[0] == 0 and last.tolist()[0] == 0 and child.tolist()[0] == 1
    assert (value / 2 ** 30).tolist() == [3, 1, 5, 4, 6] and child.tolist()[3:] == [3, 4]


def test_draws_are_poisson_and_differ_by_tree():
    x, y = values(20_000)
    bins = local_bins(x)
    base = trees.Rows(local_rows(x, y, bins, 5000))
    first, second = (np.concatenate([b.weight for b in trees._drawn(base, 42, k)]) for k in (0, 1))
    assert first.sum() / 20_000 == pytest.approx(1, abs=0.03)
    assert len(first) / 20_000 == pytest.approx(1 - np.exp(-1), abs=0.015)
    assert len(first) != len(second) or (first != second).any()
    assert np.isnan(trees.grow_tree(trees.Rows(), bins, 3)[3]).all()


def test_odd_tables(spark):
    x, y = values(30)
    same = fitted(trees.TreeTaskForestRegressor, table(spark, x, np.full(30, 4.5)), numTrees=3)
    assert {r.p for r in same.transform(table(spark, x, y)).collect()} == {4.5}
    flat = fitted(trees.TreeTaskForestRegressor, table(spark, np.zeros((30, 2)), y), numTrees=200)
    assert flat.transform(table(spark, np.ones((1, 2)), [0])).first().p == pytest.approx(y.mean(), abs=0.15)
    for labels in ([None] + [1.0] * 29, [float("nan")] + [1.0] * 29):
        with pytest.raises(ValueError):
            fitted(trees.TreeTaskForestRegressor, table(spark, x, labels))
    with pytest.raises(ValueError):
        fitted(trees.TreeTaskForestRegressor, table(spark, x, y).limit(0))


def test_passes_do_not_follow_the_depth(spark, records):
    """MLlib sends the statistics of all nodes through one job or more for each level of the trees."""
    def jobs(depth):
        before = max(spark.sparkContext.statusTracker().getJobIdsForGroup())
        models.out_of_fold(records, trees=2, max_depth=depth)
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before

    records.count()
    assert abs(jobs(9) - jobs(2)) < 3


def test_folds_are_not_broadcast(records, monkeypatch):
    plans, materialize = {}, models.materialize

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name)

    monkeypatch.setattr(models, "materialize", watched)
    assert models.out_of_fold(records, trees=1, max_depth=2).count() == records.count()
    assert "SortMergeJoin" in plans["folds"]
