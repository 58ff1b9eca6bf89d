"""Networks of dense layers, trained by passes over all rows: a pass multiplies matrices batch by batch inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.learners import initialised, optimised

CLIP = 1e-15


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: An activation, and the slope of the loss before it from its output ``a`` and the slope ``g`` after it.
ACTIVATIONS = {
    "linear": (lambda z: z, lambda a, g: g),
    "relu": (lambda z: np.maximum(z, 0.0), lambda a, g: g * (a > 0)),
    "leaky_relu": (lambda z: np.where(z > 0, z, 0.01 * z), lambda a, g: g * np.where(a > 0, 1.0, 0.01)),
    "elu": (lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0.0))), lambda a, g: g * np.where(a > 0, 1.0, a + 1.0)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda a, g: g * a * (1 - a)),
    "tanh": (np.tanh, lambda a, g: g * (1 - a * a)),
    "softmax": (_softmax, lambda a, g: a * (g - (g * a).sum(axis=1, keepdims=True))),
}


def _clipped(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.clip(p, CLIP, 1 - CLIP), (p > CLIP) & (p < 1 - CLIP)


def _squared(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((p - y) ** 2).mean(axis=1), 2 * (p - y) / y.shape[1]


def _absolute(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.abs(p - y).mean(axis=1), np.sign(p - y) / y.shape[1]


def _huber(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e, near = p - y, np.abs(p - y) <= 1
    return np.where(near, e * e / 2, np.abs(e) - 0.5).mean(axis=1), np.where(near, e, np.sign(e)) / y.shape[1]


def _binary(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, inside = _clipped(p)
    return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean(axis=1), inside * (q - y) / (q * (1 - q)) / y.shape[1]


def _categorical(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, inside = _clipped(p)
    return -(y * np.log(q)).sum(axis=1), inside * -y / q


def _hinge(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(1 - y * p, 0.0).sum(axis=1), np.where(y * p < 1, -y, 0.0)


#: A row's loss and its slope by the outputs; the loss of a table is the mean over its rows.
LOSSES = {"squared": _squared, "absolute": _absolute, "huber": _huber, "binary": _binary, "categorical": _categorical, "hinge": _hinge}


@dataclass
class Network:
    """``weights`` of each layer: a row for each input and one for the biases; ``losses`` before each epoch's step."""

    weights: list[np.ndarray]
    activations: list[str]
    losses: list[float]

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """What comes into the first layer and out of every layer."""
        out = [x]
        for w, name in zip(self.weights, self.activations, strict=True):
            out.append(ACTIVATIONS[name][0](out[-1] @ w[:-1] + w[-1]))
        return out

    def slopes(self, x: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
        """Loss and slopes of all parameters, layer after layer, summed over the rows."""
        out = self.outputs(x)
        cost, g = LOSSES[loss](out[-1], y)
        found = []
        for k in range(len(self.weights) - 1, -1, -1):
            g = ACTIVATIONS[self.activations[k]][1](out[k + 1], g)
            found.append(np.vstack([out[k].T @ g, g.sum(axis=0)]).ravel())
            g = g @ self.weights[k][:-1].T
        return float(cost.sum()), np.concatenate(found[::-1])


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has ``width`` finite components; false for null."""
    fine = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == width) & fine, F.lit(False))


def starting(spark: SparkSession, sizes: list[int], rule: str | None = "xavier_uniform", seed: int = 0) -> list[np.ndarray]:
    """Weights of layers by a hash of seed and place (zero without a rule), and zero biases."""
    out, row = [], 0
    for fan_in, fan_out in zip(sizes, sizes[1:], strict=False):
        w = np.zeros((fan_in + 1, fan_out))
        if rule:
            cells = spark.range(fan_in * fan_out).select(F.expr(f"{row} + id div {fan_out}").alias("i"), (F.col("id") % fan_out).alias("j"))
            drawn = cells.select("i", "j", initialised(F.col("i"), F.col("j"), rule, fan_in, fan_out, seed).alias("v"))
            for r in drawn.collect():
                w[r["i"] - row, r["j"]] = r["v"]
        out.append(w)
        row += fan_in + 1
    return out


def train(
    rows: DataFrame, vector: str, target: str, sizes: list[int], activations: list[str], loss: str, epochs: int,
    rule: str = "sgd", rate: float = 0.01, decay: float = 0.0, initial: str | None = "xavier_uniform", seed: int = 0,
) -> Network:
    """A network of layers of ``sizes`` (inputs first), fitted by whole passes: one aggregation an epoch.

    Each task sums the slopes over its rows and gives one row; those are added by parameter, and ``optimised`` steps on
    the table of parameters by its ``rule``.  The driver holds the network between passes, never rows.  ``target`` is an
    array as wide as the last layer; ``decay`` adds that share of a weight (not of a bias) to its slope.  Rows take no
    part where either array is null, of another width, or holds a null or non-finite number; without any row the
    network stays as it began, with no losses.
    """
    if len(activations) != len(sizes) - 1 or loss not in LOSSES or not set(activations) <= set(ACTIVATIONS):
        raise ValueError("one known activation for each layer and a known loss, please")
    spark = rows.sparkSession
    doubles = lambda c: F.transform(c, lambda v: v.cast("double"))
    kept = rows.filter(usable(F.col(vector), sizes[0]) & usable(F.col(target), sizes[-1])).select(doubles(vector).alias("x"), doubles(target).alias("y"))
    network = Network(starting(spark, sizes, initial, seed), activations, [])
    row, column, _ = (np.array(c) for c in zip(*cells(network.weights), strict=True))
    shrinks = np.where(np.isin(row, np.cumsum([n + 1 for n in sizes[:-1]]) - 1), 0.0, decay)
    held = {"i": row, "j": column, "v": np.concatenate([w.ravel() for w in network.weights]), "m": np.zeros(len(row)), "s": np.zeros(len(row))}
    for epoch in range(epochs):
        summed = kept.mapInArrow(_partial(network, loss), "sums array<double>").select(F.posexplode("sums").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g"))
        sums = np.array([r["g"] for r in sorted(summed.collect())])
        if not len(sums):
            break
        network.losses.append(float(sums[0] / sums[1]))
        # The table of parameters is a local one: a step on it needs no job.
        table = spark.createDataFrame(pa.table({**held, "g": sums[2:] / sums[1] + shrinks * held["v"]}))
        stepped = optimised(table, rule, epoch + 1, rate).toArrow().sort_by([("i", "ascending"), ("j", "ascending")])
        held = {c: stepped[c].to_numpy() for c in "ijvms"}
        network = Network(_layers(held["v"], sizes), activations, network.losses)
    return network


def cells(weights: list[np.ndarray]) -> Iterator[tuple[int, int, float]]:
    """Rows of all layers are numbered one after the other."""
    row = 0
    for w in weights:
        for line in w:
            yield from ((row, j, float(v)) for j, v in enumerate(line))
            row += 1


def _layers(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for fan_in, fan_out in zip(sizes, sizes[1:], strict=False):
        out.append(values[at : at + (fan_in + 1) * fan_out].reshape(fan_in + 1, fan_out))
        at += (fan_in + 1) * fan_out
    return out


def _partial(network: Network, loss: str):
    """A task's summed loss, number of rows and slopes, as one row."""
    width, outputs = network.weights[0].shape[0] - 1, network.weights[-1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                cost, slopes = network.slopes(_vectors(b.column("x"), width), _vectors(b.column("y"), outputs), loss)
                here = np.concatenate([[cost, b.num_rows], slopes])
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

    return run


def scores(vector: Column, network: Network) -> Column:
    """The outputs for a vector; null where it is not one of the right width and of finite numbers."""
    width = network.weights[0].shape[0] - 1

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        there = x[x.notna()]
        found = iter(network.outputs(np.stack(there.to_numpy()))[-1] if len(there) else [])
        return pd.Series([next(found) if known else None for known in x.notna()], dtype=object)

    return run(F.when(usable(vector, width), F.transform(vector, lambda v: v.cast("double"))))


def largest(outputs: Column) -> Column:
    """The place of the largest output, from 0; of equal ones the first; null for null."""
    return (F.array_position(outputs, F.array_max(outputs)) - 1).cast("int")


def one_of(label: Column, classes: int, off: float = 0.0) -> Column:
    """A class number as an array: 1 in its place, ``off`` elsewhere; null for null and for other numbers."""
    known = F.when((label >= 0) & (label < classes), label)
    return F.when(known.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == known, 1.0).otherwise(off)))
