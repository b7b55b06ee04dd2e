"""Regression forest whose trees are grown side by side, one tree in one task.

MLlib's forest sends the statistics of every node, feature and bin from every
task to find a split.  With all features at every node and deep trees these are
many times the rows.  Here the rows are binned once, to a few bytes for each
feature of a row that is not zero, and every task reads all of them and grows
its share of the trees; only finished trees leave a task.

A task holds at most MOST cells of a node in memory, and nodes of more rows in
temporary files that it reads in blocks.  Labels are fixed-point numbers, so
sums are exact, and a tree does not depend on how its rows are cut into blocks.
"""

import pickle
import tempfile
from collections.abc import Iterable, Iterator
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from advisoryspark.session import scratch

#: Cells and rows of a block; a node of more is kept in a file.
MOST = 1 << 22
#: Rows that the quantiles of a feature are taken from, as in MLlib.
SAMPLE = 10_000

_TREE = "tree int, feature binary, last binary, child binary, value binary"


class Bins(NamedTuple):
    """Split points of every feature, and the bin that holds zero.  A value equal to a point lies left of it."""
    points: list[np.ndarray]
    zero: np.ndarray
    width: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """The bin of every value of a matrix."""
        found = np.empty(x.shape, dtype=np.uint16)
        for f, points in enumerate(self.points):
            found[:, f] = np.searchsorted(points, x[:, f])
        return found


class Block(NamedTuple):
    """Rows one after another.  A cell is feature * width + bin; cells of zero's bin are left out."""
    cells: np.ndarray
    lengths: np.ndarray
    weight: np.ndarray
    label: np.ndarray

    def only(self, rows: np.ndarray, cells: np.ndarray | None = None) -> "Block":
        cells = np.repeat(rows, self.lengths) if cells is None else cells
        return Block(self.cells[cells], self.lengths[rows], self.weight[rows], self.label[rows])


class Rows:
    """Blocks of rows: one in memory, or several in a temporary file."""

    def __init__(self, blocks: Iterable[Block] = ()):
        self.blocks, self.held, self.file = [], 0, None
        for block in blocks:
            self.add(block)

    def add(self, block: Block) -> None:
        if len(block.lengths):
            self.blocks.append(block)
            self.held += len(block.cells) + len(block.lengths)
        if self.held > MOST:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(tuple(self._joined()), self.file, protocol=5)
            self.blocks, self.held = [], 0

    def _joined(self) -> Block:
        return Block(*map(np.concatenate, zip(*self.blocks))) if len(self.blocks) > 1 else self.blocks[0]

    def __iter__(self) -> Iterator[Block]:
        if self.file:
            end = self.file.seek(0, 2)
            self.file.seek(0)
            while self.file.tell() < end:
                yield Block(*pickle.load(self.file))
        if self.blocks:
            self.blocks = [self._joined()]
            yield self.blocks[0]

    def alike(self) -> bool:
        """Whether all rows have one label; not looked up in files."""
        return self.file is None and all((b.label == self.blocks[0].label[0]).all() for b in self.blocks)


# --- bins --------------------------------------------------------------------------

def split_points(values: np.ndarray, splits: int) -> np.ndarray:
    """Middles between neighbouring values: all of them, or `splits` at most about equally many rows apart."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) <= splits:
        return middles
    stride, reached, kept = len(values) / (splits + 1), np.cumsum(counts), []
    target = stride
    for i in range(len(middles)):
        if abs(reached[i] - target) < abs(reached[i + 1] - target):
            kept.append(middles[i])
            target += stride
    return np.array(kept)


def _matrix(vectors: pa.Array) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def find_bins(rows: DataFrame, n: int, max_bins: int, seed: int) -> Bins:
    """The bins of all features, from some SAMPLE rows that come to the driver."""
    wanted = max(max_bins ** 2, SAMPLE)
    some = rows.select("features")
    seen = _matrix((some.sample(wanted / n, seed) if n > wanted else some).toArrow()["features"])
    points = [split_points(column, min(max_bins, n) - 1) for column in seen.T]
    zero = np.array([np.searchsorted(p, 0.0) for p in points], dtype=np.intp)
    return Bins(points, zero, max((len(p) for p in points), default=0) + 1)


def _coder(bins: Bins):
    """Arrow batches of (label, features) to (label, cells)."""
    kind = np.uint16 if len(bins.points) * bins.width <= 1 << 16 else np.uint32
    first = (np.arange(len(bins.points)) * bins.width).astype(kind)

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("features"))
            if not np.isfinite(x).all():
                raise ValueError("a feature is not finite")
            found = bins.of(x)
            kept = found != bins.zero
            cells = found + first
            ends = np.concatenate([[0], kept.sum(axis=1).cumsum()]) * cells.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(x), [
                None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cells[kept].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("label"), packed], ["label", "cells"])

    return code, kind


def _blocks(batches, kind, centre: float, scale: float) -> Iterator[Block]:
    for batch in batches:
        if batch.num_rows:
            packed = batch.column("cells").cast(pa.binary())
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
            raw = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
            label = np.rint((batch.column("label").to_numpy() - centre) * scale)
            yield Block(raw.copy().view(kind), (np.diff(ends) // np.dtype(kind).itemsize).astype(np.int32),
                        np.ones(len(label), dtype=np.uint8), label)


# --- one tree ----------------------------------------------------------------------

def _statistics(rows: Rows, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Weight and sum of labels of every feature and bin, and of all rows."""
    size = len(bins.points) * bins.width
    found, total = np.zeros((2, size)), np.zeros(2)
    for block in rows:
        cells, weight = block.cells.astype(np.intp), block.weight.astype(float)
        for i, per_row in enumerate((weight, weight * block.label)):
            found[i] += np.bincount(cells, np.repeat(per_row, block.lengths), size)
            total[i] += per_row.sum()
    found = found.reshape(2, len(bins.points), bins.width)
    found[:, np.arange(len(bins.points)), bins.zero] += total[:, None] - found.sum(axis=2)
    return found, total


def _best_split(found: np.ndarray, total: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """Feature, last bin to the left and what goes left, of the split that lowers the variance most; the first of equals."""
    left = found.cumsum(axis=2)[:, :, :-1]
    weight, label = left
    more = total[0] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = label ** 2 / weight + (total[1] - label) ** 2 / more
    gain[(weight <= 0) | (more <= 0)] = -1
    if not gain.size:
        return None
    feature, last = divmod(int(gain.argmax()), gain.shape[1])
    if gain[feature, last] <= total[1] ** 2 / total[0] * (1 + 1e-12):
        return None
    return feature, last, left[:, feature, last].copy()


def _parted(rows: Rows, feature: int, last: int, bins: Bins) -> tuple[Rows, Rows]:
    """Rows whose bin of the feature is at most `last`, and the others."""
    left, right = Rows(), Rows()
    first, zero_left = feature * bins.width, bins.zero[feature] <= last
    low, high = (first + last + 1, first + bins.width - 1) if zero_left else (first, first + last)
    for block in rows:
        hit = np.flatnonzero((block.cells >= low) & (block.cells <= high))
        goes_left = np.full(len(block.lengths), zero_left)
        goes_left[np.searchsorted(np.cumsum(block.lengths), hit, side="right")] = not zero_left
        cells = np.repeat(goes_left, block.lengths)
        left.add(block.only(goes_left, cells))
        right.add(block.only(~goes_left, ~cells))
    return left, right


def grow_tree(rows: Rows, bins: Bins, max_depth: int) -> tuple[np.ndarray, ...]:
    """Feature, last bin to the left, first of two children and value of every node, the root first.

    A leaf is its own child and has all bins to the left.  Only the smaller of two
    children is counted; the other is the parent less that.  No rows have no value (nan).
    """
    nodes = []

    def add(total: np.ndarray) -> int:
        nodes.append([0, bins.width, len(nodes), total])
        return len(nodes) - 1

    found, total = _statistics(rows, bins)
    root = add(total)
    open_nodes = [(root, rows, found, 0)] if total[0] and max_depth else []
    while open_nodes:
        at, rows, found, depth = open_nodes.pop()
        total = nodes[at][3]
        best = _best_split(found, total)
        if best is None:
            continue
        feature, last, goes_left = best
        children = [add(goes_left), add(total - goes_left)]
        nodes[at][:3] = feature, last, children[0]
        if depth + 1 == max_depth:
            continue
        parts = _parted(rows, feature, last, bins)
        grown = [not part.alike() for part in parts]
        if any(grown):
            small = int(total[0] - goes_left[0] < goes_left[0])
            counted, _ = _statistics(parts[small], bins)
            counts = [found - counted, found - counted]
            counts[small] = counted
            open_nodes += [(children[k], parts[k], counts[k], depth + 1) for k in (0, 1) if grown[k]]
    feature, last, child, totals = zip(*nodes)
    weight, label = np.array(totals).T
    return (np.array(feature, dtype=np.uint16), np.array(last, dtype=np.uint16), np.array(child, dtype=np.int32),
            np.divide(label, weight, out=np.full(len(label), np.nan), where=weight > 0))


def _drawn(rows: Rows, seed: int, tree: int) -> Iterator[Block]:
    """The rows of one tree, each as often as its Poisson draw says."""
    random = np.random.default_rng([seed % 2 ** 64, tree])
    for block in rows:
        weight = random.poisson(1.0, len(block.lengths)).astype(np.uint8)
        yield block._replace(weight=weight).only(weight > 0)


# --- estimator and model -------------------------------------------------------------

class TreeTaskForestRegressor(RandomForestRegressor):
    """`RandomForestRegressor` with all features at every split, fitted without a shuffle of statistics.

    Reads the columns, numTrees, maxDepth, maxBins, bootstrap and seed; the other
    parameters have their defaults.  Quantiles, rule of the split, leaves and the
    Poisson draw with mean one are MLlib's, its random numbers are not.
    """

    def _fit(self, dataset: DataFrame) -> "ForestModel":
        trees, max_depth, seed, draw = self.getNumTrees(), self.getMaxDepth(), self.getSeed(), self.getBootstrap()
        rows = dataset.select(F.col(self.getLabelCol()).cast("double").alias("label"),
                              vector_to_array(self.getFeaturesCol()).alias("features"))
        about = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("centre"), F.min("label").alias("low"),
                         F.max("label").alias("high"),
                         F.count_if(F.abs("label") < F.lit(float("inf"))).alias("finite")).first()
        if not about["n"] or about["finite"] < about["n"]:
            raise ValueError(f"{about['finite']} of {about['n']} rows have a finite label")
        n, centre, reach = about["n"], about["centre"], about["high"] - about["low"]
        # Sums of all draws stay under 2**52, so they are exact.
        scale = 2.0 ** np.floor(52 - np.log2((4 * n + 64) * reach)) if reach else 1.0
        bins = find_bins(rows, n, self.getMaxBins(), seed)
        code, kind = _coder(bins)

        def growing(share: range):
            def grow(batches):
                base = Rows(_blocks(batches, kind, centre, scale))
                for tree in share:
                    grown = grow_tree(Rows(_drawn(base, seed, tree)) if draw else base, bins, max_depth)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in grown]],
                        ["tree", "feature", "last", "child", "value"])
            return grow

        tasks = min(trees, dataset.sparkSession.sparkContext.defaultParallelism)
        with scratch(rows.mapInArrow(code, "label double, cells binary"), "binned") as coded:
            with ThreadPool(tasks) as pool:
                parts = pool.map(lambda k: coded.coalesce(1).mapInArrow(
                    growing(range(k, trees, tasks)), _TREE).collect(), range(tasks), chunksize=1)
        grown = sorted((tree for part in parts for tree in part), key=lambda tree: tree["tree"])
        return ForestModel([(
            np.frombuffer(t["feature"], np.uint16), np.frombuffer(t["last"], np.uint16), np.frombuffer(t["child"], np.int32),
            # A tree without rows says 0, as MLlib's.
            np.nan_to_num(centre + np.frombuffer(t["value"]) / scale, nan=0.0)) for t in grown],
            bins, max_depth, self.getFeaturesCol(), self.getPredictionCol())


class ForestModel(Model):
    """Trees as arrays; the prediction is the mean of the trees'."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], bins: Bins, max_depth: int, features: str, prediction: str):
        super().__init__()
        self.trees, self.bins, self.max_depth, self.features, self.prediction = trees, bins, max_depth, features, prediction

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.prediction, self._mean_of(vector_to_array(self.features)))

    def _mean_of(self, vectors: Column) -> Column:
        trees, bins, max_depth = self.trees, self.bins, self.max_depth

        @F.arrow_udf("double")
        def mean(batch: pa.Array) -> pa.Array:
            if not len(batch):
                return pa.array([], pa.float64())
            found = bins.of(_matrix(batch))
            flat, start, summed = found.ravel(), np.arange(len(found)) * found.shape[1], np.zeros(len(found))
            for feature, last, child, value in trees:
                at = np.zeros(len(found), dtype=np.intp)
                for _ in range(max_depth):
                    at = child[at] + (flat[start + feature[at]] > last[at])
                summed += value[at]
            return pa.array(summed / len(trees))

        return mean(vectors)
