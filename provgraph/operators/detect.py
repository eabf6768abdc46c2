"""Forecasting snapshot vectors from their predecessors, and scoring the error."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.cluster import checkpointed, dense_ids, ship_package
from provgraph.functions import squared_error

#: Predecessors that a forecast sees, and the error beyond which a snapshot is anomalous.
LAGS, THRESHOLD = 12, 0.016
#: Hashed features of a window of all dimensions; bounds the normal equations, which one machine solves.
FEATURES = 256


def sequence(vectors: DataFrame, order: str, vector: str) -> DataFrame:
    """``seq`` from 0 in order, ``vec`` as doubles."""
    return vectors.join(dense_ids(vectors, order, "seq"), order).withColumn("vec", F.col(vector).cast("array<double>"))


def lag_windows(seq: DataFrame, lags: int = LAGS) -> DataFrame:
    """``window``: the vectors before each position, oldest first, zero vectors in front where there are fewer.

    Position 0 sees itself ``lags`` times. A vector is sent to the positions that see it, so no task holds the sequence.
    """
    sent = seq.select(F.col("vec").alias("seen"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), F.col("seq").alias("from")).select((F.col("from") + F.col("lag")).alias("seq"), "lag", "seen")
    past = sent.groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("lag")).alias("k"), "seen"))), lambda x: x["seen"]).alias("past"))
    zero = F.transform("vec", lambda x: x * 0.0)
    padded = F.concat(F.array_repeat(zero, F.lit(lags) - F.size("past")), F.col("past"))
    window = F.when(F.col("seq") == 0, F.array_repeat("vec", lags)).otherwise(padded)
    return seq.join(past, "seq", "left").withColumn("past", F.coalesce("past", F.array().cast("array<array<double>>"))).withColumn("window", window).drop("past")


def training_windows(seq: DataFrame, lags: int = LAGS) -> DataFrame:
    """Full windows that end with their own target: ``seq`` of the target and ``window``.

    A sequence shorter than a window gives one, filled with zero vectors at its end, for its last position.
    """
    sent = seq.select(F.col("vec").alias("seen"), F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag"), F.col("seq").alias("from"))
    grouped = sent.groupBy((F.col("from") + F.col("lag")).alias("seq")).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("lag")).alias("k"), "seen"))), lambda x: x["seen"]).alias("window"))
    last = seq.agg(F.max("seq").alias("last"))
    whole = grouped.join(seq.select("seq"), "seq").crossJoin(F.broadcast(last))
    short = (F.col("last") < lags - 1) & (F.col("seq") == F.col("last"))
    zero = F.transform(F.col("window")[0], lambda x: x * 0.0)
    filled = F.concat("window", F.array_repeat(zero, F.lit(lags) - F.size("window")))
    return whole.where((F.size("window") == lags) | short).select("seq", filled.alias("window"))


def chronological_split(seq: DataFrame, share: float = 0.8) -> DataFrame:
    """``part``: train for the first share of positions, validation for the rest."""
    size = seq.agg((F.max("seq") + 1).alias("n"))
    return seq.crossJoin(F.broadcast(size)).withColumn("part", F.when(F.col("seq") < F.floor(F.col("n") * share), "train").otherwise("validation")).drop("n")


def mean_forecast(windows: DataFrame, lags: int = LAGS) -> DataFrame:
    """``pred``: the mean of the window."""
    total = F.aggregate("window", F.transform("vec", lambda x: x * 0.0), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return windows.withColumn("pred", F.transform(total, lambda x: x / lags))


def scores(forecasts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``error``: mean squared difference, ``flag``: 1 beyond the threshold."""
    return forecasts.withColumn("error", squared_error(F.col("pred"), F.col("vec"))).withColumn("flag", (F.col("error") > threshold).cast("int"))


def differences(scored: DataFrame) -> DataFrame:
    """Forecast minus truth for the anomalous positions."""
    return scored.where("flag = 1").withColumn("diff", F.zip_with("pred", "vec", lambda p, x: p - x))


def lagged_values(windows: DataFrame) -> DataFrame:
    """One row per position and dimension: ``dim``, ``x`` (window values, oldest first), ``y``."""
    return windows.select("seq", "window", F.posexplode("vec").alias("dim", "y")).withColumn("x", F.transform("window", lambda v: F.element_at(v, F.col("dim") + 1))).drop("window")


def gram(values: DataFrame, lags: int = LAGS) -> DataFrame:
    """Cells of the normal equations per dimension, in one aggregation: ``dim, i, j, value``; j = lags holds x_i * y."""
    x = [F.element_at("x", i + 1) for i in range(lags)]
    sums = [F.sum(x[i] * (x[j] if j < lags else F.col("y"))).alias(f"{i}_{j}") for i in range(lags) for j in range(i, lags + 1)]
    wide = values.groupBy("dim").agg(*sums)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}_{j}").alias("value")) for i in range(lags) for j in range(i, lags + 1)]))
    return wide.select("dim", cells.alias("c")).select("dim", "c.*")


def fit_autoregression(cells: DataFrame, ridge: float = 1.0, lags: int = LAGS) -> DataFrame:
    """``dim``, ``weights``: ridge solutions; each group is one dimension's cells, a fixed small number."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((lags, lags)), np.zeros(lags)
        for i, j, v in zip(rows["i"], rows["j"], rows["value"]):
            if j == lags:
                b[i] = v
            else:
                a[i, j] = a[j, i] = v
        w = np.linalg.solve(a + ridge * np.eye(lags), b)
        return pd.DataFrame({"dim": [int(rows["dim"].iloc[0])], "weights": [w.tolist()]})

    return cells.groupBy("dim").applyInPandas(solve, "dim int, weights array<double>")


def autoregression_forecast(windows: DataFrame, weights: DataFrame) -> DataFrame:
    """``pred`` from fitted weights, one row of weights for each dimension."""
    values = lagged_values(windows).join(F.broadcast(weights), "dim")
    each = values.withColumn("p", F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, v: s + v))
    pred = each.groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "p"))), lambda v: v["p"]).alias("pred"))
    return windows.join(pred, "seq")


def projection(lags: int, dims: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of a window, lag by lag, its feature and its sign, by the md5 of ``lag|dimension``; each cell its own feature if they suffice."""
    if lags * dims <= size:
        return np.arange(lags * dims), np.ones(lags * dims)
    drawn = [int(hashlib.md5(f"{i}|{d}".encode()).hexdigest()[:15], 16) for i in range(lags) for d in range(dims)]
    return np.array([h % size for h in drawn]), np.array([1.0 - 2 * (h // size % 2) for h in drawn])


#: Windows that are turned to features at a time.
SLICE = 500


def matrix(lists: pa.Array) -> np.ndarray:
    """Arrow lists of equal length as rows of numbers, without a Python object for each."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1)


def featured(cells: np.ndarray, lags: int, size: int) -> np.ndarray:
    """One row of hashed features for each window of all dimensions, a row of ``cells``."""
    index, sign = projection(lags, cells.shape[1] // lags, size)
    out = np.zeros((len(cells), size))
    np.add.at(out.T, index, (cells * sign).T)
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow's batches, ``SLICE`` rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def joint_gram(windows: DataFrame, lags: int = LAGS, size: int = FEATURES) -> DataFrame:
    """Rows of the normal equations of all dimensions together: ``i``, ``values`` (products with every feature, then with every dimension).

    A task sums over its windows, a slice at a time, and gives one row for each feature; cells are then added as columns.
    """
    ship_package(windows.sparkSession)

    def sums(batches):
        total = None
        for rows in slices(batches):
            z = featured(matrix(rows.column("window")), lags, size)
            part = z.T @ np.hstack([z, matrix(rows.column("vec"))])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "values"])

    cells = flat(windows).mapInArrow(sums, "i int, values array<double>").select("i", F.posexplode("values").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("values"))


def flat(windows: DataFrame) -> DataFrame:
    return windows.select(F.flatten("window").alias("window"), "vec")


@dataclass
class Joint:
    """A forecaster of all dimensions from hashed features of the window: weights by feature and dimension, and how they were chosen."""

    weights: np.ndarray
    lags: int
    ridge: float
    errors: dict[float, float]

    def forecast(self, windows: DataFrame) -> DataFrame:
        weights, lags = self.weights, self.lags

        @F.arrow_udf("array<double>")
        def pred(cells: pa.Array) -> pa.Array:
            parts = [featured(matrix(cells.slice(start, SLICE)), lags, len(weights)) @ weights for start in range(0, len(cells), SLICE)]
            return pa.array([row for part in parts for row in part], pa.list_(pa.float64()))

        ship_package(windows.sparkSession)
        return windows.withColumn("pred", pred(F.flatten("window")))


def fit_joint(seq: DataFrame, ridges: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), lags: int = LAGS, size: int = FEATURES) -> Joint:
    """Fit on the first four fifths of the sequence and take the ridge of least error on the rest; the smallest on ties.

    One job sums the normal equations, ``size`` rows of a fixed width; their eigenvectors give the weights of every ridge at once, and one
    more job sums the errors of all of them.
    """
    split = chronological_split(lag_windows(seq, lags))
    rows = sorted(joint_gram(split.where("part = 'train'"), lags, size).collect(), key=lambda r: r.i)
    if not rows:
        raise ValueError("no snapshots to train on")
    cells = np.array([r["values"] for r in rows])
    values, vectors = np.linalg.eigh(cells[:, :size])
    turned = vectors.T @ cells[:, size:]
    every = {ridge: vectors @ (turned / (np.maximum(values, 0) + ridge)[:, None]) for ridge in ridges}

    def errors(batches):
        total = dict.fromkeys(every, 0.0)
        for rows in slices(batches):
            z, y = featured(matrix(rows.column("window")), lags, size), matrix(rows.column("vec"))
            for ridge, weights in every.items():
                total[ridge] += float((((z @ weights) - y) ** 2).mean(axis=1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array(list(total.values()), pa.float64())], names=["ridge", "error"])

    found = flat(split.where("part = 'validation'")).mapInArrow(errors, "ridge double, error double").groupBy("ridge").agg(F.sum("error").alias("error"))
    by_ridge = {r.ridge: r.error for r in found.collect()}
    best = min(ridges, key=lambda r: (round(by_ridge.get(r, 0.0), 12), r))
    return Joint(every[best], lags, best, by_ridge)


def choose_ridge(seq: DataFrame, ridges: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), lags: int = LAGS) -> DataFrame:
    """``ridge``, ``error``, ``best``: validation errors of forecasts dimension by dimension for every ridge on a chronological split, in one job.

    The ridge stands in the key of the groups that are solved and of the values that are forecast, so no value waits for another.
    """
    split = chronological_split(lag_windows(seq, lags))
    cells = checkpointed(gram(lagged_values(split.where("part = 'train'")), lags))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((lags, lags)), np.zeros(lags)
        for i, j, v in zip(rows["i"], rows["j"], rows["value"]):
            if j == lags:
                b[i] = v
            else:
                a[i, j] = a[j, i] = v
        solved = [np.linalg.solve(a + ridge * np.eye(lags), b).tolist() for ridge in ridges]
        return pd.DataFrame({"dim": int(rows["dim"].iloc[0]), "ridge": list(ridges), "weights": solved})

    weights = cells.groupBy("dim").applyInPandas(solve, "dim int, ridge double, weights array<double>")
    each = lagged_values(split.where("part = 'validation'")).join(weights, "dim")
    wrong = F.aggregate(F.zip_with("x", "weights", lambda x, w: x * w), F.lit(0.0).cast("double"), lambda s, v: s + v) - F.col("y")
    errors = each.groupBy("ridge", "seq").agg(F.avg(wrong * wrong).alias("error")).groupBy("ridge").agg(F.avg("error").alias("error"))
    first = F.min(F.struct(F.round("error", 12), "ridge")).over(Window.partitionBy(F.lit(0)))
    return errors.withColumn("best", first["ridge"] == F.col("ridge"))
