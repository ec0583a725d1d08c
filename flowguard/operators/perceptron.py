"""A perceptron on wide sparse vectors.

MLlib's trainer stacks its rows into dense blocks and keeps them: 131 kB for a row of 16 384 hashed
words, however few of them it has.  Here the loss and its gradient are summed over the sparse rows,
batch by batch in the tasks, and only sums of the size of the model reach the driver, where L-BFGS
takes its step.  Start, layers, loss and the fitted model are MLlib's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from flowguard.session import work_folder

SLICE = 512  # rows that are summed at once
MEMORY = 10  # steps that L-BFGS remembers
TRIES = 20  # lengths of a step that are tried
SPARSE = "x struct<type: tinyint, size: int, indices: array<int>, values: array<double>>, label double"


def unpacked(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights by input, bias) of each layer, as MLlib lays them out in one vector."""
    found, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        end = at + n_in * n_out
        found.append((weights[at:end].reshape(n_in, n_out), weights[end : end + n_out]))
        at = end + n_out
    return found


def loss_and_gradient(
    weights: np.ndarray, layers: Sequence[int], row: np.ndarray, place: np.ndarray, value: np.ndarray, label: np.ndarray
) -> tuple[float, np.ndarray]:
    """Summed cross-entropy and its gradient over the rows of ``label``; entry k is ``value[k]`` at ``place[k]`` of ``row[k]``."""
    (first, bias), *rest = unpacked(weights, layers)
    n, wide = len(label), layers[0]
    z = np.stack([np.bincount(row, value * first[place, j], n) for j in range(layers[1])], axis=1) + bias
    outs = [1 / (1 + np.exp(-z))]
    for k, (w, b) in enumerate(rest):
        z = outs[-1] @ w + b
        outs.append(1 / (1 + np.exp(-z)) if k < len(rest) - 1 else np.exp(z - z.max(axis=1, keepdims=True)))
    outs[-1] /= outs[-1].sum(axis=1, keepdims=True)
    own = outs[-1][np.arange(n), label]
    delta = outs.pop()
    delta[np.arange(n), label] -= 1
    parts: list[np.ndarray] = []
    for w, _ in reversed(rest):
        parts = [(outs[-1].T @ delta).ravel(), delta.sum(axis=0), *parts]
        delta = (delta @ w.T) * outs[-1] * (1 - outs[-1])
        outs.pop()
    wide_part = np.stack([np.bincount(place, value * delta[row, j], wide) for j in range(layers[1])], axis=1)
    return float(-np.log(np.maximum(own, 1e-300)).sum()), np.concatenate([wide_part.ravel(), delta.sum(axis=0), *parts])


def summed(rows: DataFrame, layers: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and gradient over all rows; a task gives one sum."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient, count = 0.0, np.zeros(len(weights)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = part.column(0)
                places = pa.compute.struct_field(x, "indices")
                n = np.diff(places.offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), n)
                value = pa.compute.struct_field(x, "values").flatten().to_numpy(zero_copy_only=False)
                label = part.column(1).to_numpy(zero_copy_only=False).astype(int)
                more = loss_and_gradient(weights, layers, row, places.flatten().to_numpy(zero_copy_only=False), value, label)
                loss, gradient, count = loss + more[0], gradient + more[1], count + part.num_rows
        yield pa.RecordBatch.from_pydict({"loss": [loss], "n": [count], "gradient": [gradient.tobytes()]})

    loss, gradient, count = 0.0, np.zeros(len(weights)), 0
    for found in rows.mapInArrow(task, "loss double, n long, gradient binary").collect():
        loss, gradient, count = loss + found.loss, gradient + np.frombuffer(found.gradient), count + found.n
    return loss / max(1, count), gradient / max(1, count)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS; stops where a step changes the value by less than ``tolerance`` of it."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = slope.copy(), []
        for s, y in reversed(past):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.linalg.norm(slope))
        for (s, y), a in zip(past, reversed(alphas)):
            q += (a - y @ q / (s @ y)) * s
        # a step that goes down enough (Armijo) and past the steep part (weak Wolfe), by bisection
        down, step, low, high = slope @ q, 1.0, 0.0, np.inf
        for _ in range(TRIES):
            nearer = x - step * q
            found, its_slope = f(nearer)
            if not found <= value - 1e-4 * step * down:
                high = step
            elif its_slope @ q > 0.9 * down:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * low
        if not found < value:
            break
        s, y = nearer - x, its_slope - slope
        if s @ y > 1e-12:
            past = [*past[1 - MEMORY :], (s, y)]
        small = value - found <= tolerance * abs(value)
        x, value, slope = nearer, found, its_slope
        if small:
            break
    return x


def fit(prepared: DataFrame, vector: str, layers: Sequence[int], rounds: int, seed: int) -> MultilayerPerceptronClassificationModel:
    """MLlib's model of ``vector`` and ``label``, fitted on all rows of ``prepared``.

    The vectors are written once, as their parts; each step reads them again.
    """
    spark = prepared.sparkSession
    path = work_folder(spark, "perceptron")
    prepared.select(prepared[vector].alias("x"), prepared["label"].cast("double").alias("label")).write.parquet(path)
    one = spark.read.parquet(path).limit(1)
    mlp = MultilayerPerceptronClassifier(featuresCol="x", labelCol="label", layers=list(layers), solver="l-bfgs", maxIter=0, seed=seed)
    start = mlp.fit(one).weights.toArray()
    # a sum for each slot, so that what the driver gets does not grow with the rows
    rows = spark.read.schema(SPARSE).parquet(path).coalesce(spark.sparkContext.defaultParallelism)
    found = lbfgs(lambda w: summed(rows, layers, w), start, rounds)
    mlp = mlp.setInitialWeights(Vectors.dense(found)).setFeaturesCol(vector)
    return mlp.fit(one.withColumnRenamed("x", vector))
