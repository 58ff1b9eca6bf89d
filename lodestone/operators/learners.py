"""Models: trees and forests grown from best splits, hashed features of kernels, initial weights and optimizers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ml import best_splits
from lodestone.plans.lineage import spread, written


@dataclass
class Split:
    """A node of a tree: ``value`` in a leaf, else a test ``feature <= threshold``."""

    value: float | None = None
    feature: str = ""
    threshold: float = 0.0
    left: Split | None = None
    right: Split | None = None

    def predicted(self) -> Column:
        """The tree as one nested expression."""
        if self.left is None or self.right is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.threshold, self.left.predicted()).otherwise(self.right.predicted())

    def place(self, number: int = 1) -> Column:
        """The number of the leaf that a row comes to: 1 is the root, ``2 n`` and ``2 n + 1`` are below ``n``."""
        if self.left is None or self.right is None:
            return F.lit(number)
        return F.when(F.col(self.feature) <= self.threshold, self.left.place(2 * number)).otherwise(self.right.place(2 * number + 1))


def grow_tree(rows: DataFrame, features: list[str], label: str, depth: int = 3, least: int = 2, regression: bool = False) -> Split:
    """A tree by entropy gain over the label's classes, or by gain of squared error with means in its leaves.

    A level is grown at a time: one aggregation for all its leaves, one for all their splits; the driver
    holds the splits.  Of equally frequent classes the smaller one is the leaf's value; no rows give 0.
    """
    y = F.col(label).cast("double")
    rows = rows.filter(y.isNotNull())
    root = Split(value=0.0)
    at, classes = {1: root}, None
    for level in range(depth + 1):
        placed = rows.withColumn("__node", root.place())
        if regression:
            stats = {r["__node"]: (r["n"], r["mean"], None) for r in placed.groupBy("__node").agg(F.count("*").alias("n"), F.avg(y).alias("mean")).collect()}
        else:
            seen = placed.groupBy("__node", y.alias("y")).count()
            best = F.min_by("y", F.struct(-F.col("count"), "y"))
            stats = {r["__node"]: (r["n"], r["v"], r["kinds"]) for r in seen.groupBy("__node").agg(F.sum("count").alias("n"), best.alias("v"), F.count("*").alias("kinds")).collect()}
            classes = classes or [r[0] for r in seen.select("y").distinct().orderBy("y").collect()]
        for number, (_, value, _) in stats.items():
            at[number].value = float(value)
        ready = [k for k, (n, _, kinds) in stats.items() if k in at and n >= least and kinds != 1]
        if level == depth or not ready:
            break
        found = best_splits(placed.filter(F.col("__node").isin(ready)), features, label, None if regression else classes, "__node")
        grown = {}
        for r in found.filter("gain > 0").collect():
            node = at[r["node"]]
            node.feature, node.threshold, node.left, node.right = r["feature"], r["threshold"], Split(value=node.value), Split(value=node.value)
            grown |= {2 * r["node"]: node.left, 2 * r["node"] + 1: node.right}
        if not grown:
            break
        at = grown
        rows = rows.filter(root.place().isin(list(grown)))
    return root


#: Chances that a row is drawn at most 0, 1, 2, ... times when as many rows are drawn as there are (Poisson).
DRAWN = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]


@dataclass
class Forest:
    """``splits(node, feature, threshold)`` and ``leaves(node, value)``; node = tree * 2^(depth + 1) + place in its tree."""

    splits: list[DataFrame]  # by level
    leaves: DataFrame
    trees: int
    depth: int


def _step(rows: DataFrame, splits: DataFrame, features: list[str], size: int) -> DataFrame:
    """Rows moved one level down by the splits of their nodes: a row for each node at most, so they go to the rows."""
    own = rows.columns
    moved = rows.join(F.broadcast(splits.select("node", F.col("feature").alias("__feature"), F.col("threshold").alias("__threshold"))), "node", "left")
    x = F.coalesce(*(F.when(F.col("__feature") == f, F.col(f).cast("double")) for f in features))
    below = F.col("node") + F.col("node") % size + F.when(x <= F.col("__threshold"), 0).otherwise(1)
    return moved.withColumn("node", F.when(F.col("__feature").isNull(), F.col("node")).otherwise(below)).select(*own)


def _rooted(rows: DataFrame, trees: int, size: int) -> DataFrame:
    return rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.col("tree").cast("long") * size + 1)


def grow_forest(rows: DataFrame, keys: list[str], features: list[str], label: str, trees: int = 20, depth: int = 3, drawn: int | None = None, seed: int = 0, regression: bool = False) -> Forest:
    """Trees on bootstraps of the rows, a level of all trees at a time: one aggregation finds all their splits.

    How often a tree draws a row (Poisson), and which ``drawn`` of the features a node may split by (about the square root
    of them for classes, a third for numbers), come from hashes of seed, tree, ``keys`` and node: every run grows the
    same.  Rows without a label or with a null feature take no part.
    """
    size, y = 1 << (depth + 1), F.col(label).cast("double")
    drawn = drawn or max(1, len(features) // 3 if regression else round(math.sqrt(len(features))))
    whole = rows.filter(y.isNotNull()).select(*keys, *features, y.alias("__y")).na.drop(subset=features)
    # Written before it is compared: a hash for each tree and row is drawn once.
    dealt = written(_rooted(spread(whole), trees, size).select(*features, "__y", "node", _uniform(seed, F.col("tree"), *map(F.col, keys)).alias("__u")))
    times = reduce(Column.__add__, (F.when(F.col("__u") >= p, 1).otherwise(0) for p in DRAWN))
    at = dealt.filter(F.col("__u") >= DRAWN[0]).withColumn("__w", times).drop("__u")
    classes = None if regression else [r[0] for r in whole.select("__y").distinct().orderBy("__y").collect()]

    def allowed(node: Column, f: Column) -> Column:
        order = F.array(*(_uniform(seed, node, F.lit(i)) for i in range(len(features))))
        return F.size(F.filter(order, lambda u: u < F.get(order, f))) < drawn

    levels = []
    for _ in range(depth):
        found = written(best_splits(at, features, "__y", classes, "node", "__w", allowed).filter("gain > 0").select("node", "feature", "threshold"))
        levels.append(found)
        at = _step(at, found, features, size)
    if regression:
        leaves = at.groupBy("node").agg((F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")).alias("value"))
    else:
        counts = at.groupBy("node", "__y").agg(F.sum("__w").alias("n"))
        leaves = counts.groupBy("node").agg(F.min_by("__y", F.struct(-F.col("n"), "__y")).alias("value"))
    return Forest(levels, written(leaves), trees, depth)


def forest_values(rows: DataFrame, keys: list[str], features: list[str], forest: Forest) -> DataFrame:
    """``keys, tree, value``: what every tree says of every row."""
    size = 1 << (forest.depth + 1)
    at = _rooted(spread(rows.select(*keys, *features)), forest.trees, size)
    for splits in forest.splits:
        at = _step(at, splits, features, size)
    return at.join(F.broadcast(forest.leaves), "node").select(*keys, "tree", "value")


def dense(x: Column, weights: list[list[float]], bias: list[float], activation: Callable[[Column], Column]) -> Column:
    """One layer's forward pass on an array column: ``activation(W x + b)``."""

    def unit(row: list[float], b: float) -> Column:
        total = F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda a, w: a.cast("double") * w), F.lit(0.0), lambda acc, v: acc + v)
        return activation(total + F.lit(b))

    return F.array(*(unit(r, b) for r, b in zip(weights, bias, strict=True)))


def _uniform(seed: int, *index: Column) -> Column:
    """A number above 0 and below 1 that depends on seed and index alone, however rows are dealt."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in index)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def random_normal(seed: int, *index: Column) -> Column:
    """A standard normal number for an index, from two uniform ones."""
    a, b = _uniform(seed, *index, F.lit("a")), _uniform(seed, *index, F.lit("b"))
    return F.sqrt(-2 * F.ln(a)) * F.cos(2 * math.pi * b)


def fourier_features(columns: list[Column], size: int, gamma: float, seed: int = 0) -> list[Column]:
    """``size`` features whose inner products come near to the kernel ``exp(-gamma |x - y|^2)`` (to about ``1 / sqrt(size)``).

    Frequencies and phases are drawn by a hash of seed and place, so they need no table and are the same for every row and
    run.  A machine with that kernel is then a linear one on these columns: its fit is a few passes over the rows, where
    a kernel matrix would have a cell for each pair of them.
    """
    wide = math.sqrt(2 * gamma)

    def feature(j: int) -> Column:
        phase = F.lit(2 * math.pi) * _uniform(seed, F.lit(j))
        turn = reduce(Column.__add__, (x.cast("double") * (random_normal(seed, F.lit(i), F.lit(j)) * wide) for i, x in enumerate(columns)))
        return F.cos(turn + phase) * math.sqrt(2 / size)

    return [feature(j) for j in range(size)]


def initialised(i: Column, j: Column, rule: str, fan_in: int, fan_out: int, seed: int) -> Column:
    """Random weights of a matrix given as rows ``(i, j)``: uniform or normal, scaled by the rule."""
    match rule:
        case "uniform":
            return _uniform(seed, i, j) * 2 - 1
        case "xavier_uniform":
            return (_uniform(seed, i, j) * 2 - 1) * math.sqrt(6 / (fan_in + fan_out))
        case "xavier_normal":
            return random_normal(seed, i, j) * math.sqrt(2 / (fan_in + fan_out))
        case "he":
            return random_normal(seed, i, j) * math.sqrt(2 / fan_in)
    raise ValueError(f"unknown rule {rule}")


def optimised(parameters: DataFrame, rule: str, step: int, rate: float = 0.01, momentum: float = 0.9, decay: tuple[float, float] = (0.9, 0.999), epsilon: float = 1e-8) -> DataFrame:
    """One step on a table of parameters ``i, j, v, g, m, s``: value, gradient, and the two moments (0 at first).

    ``sgd``, ``momentum``, ``adagrad`` (its epsilon stands inside the root) or ``adam`` (outside); ``step`` counts from 1.
    """
    v, g, m, s = (F.col(c) for c in "vgms")
    a, b = decay
    match rule:
        case "sgd":
            new = (v - rate * g, m, s)
        case "momentum":
            moved = momentum * m - rate * g
            new = (v + moved, moved, s)
        case "adagrad":
            summed = s + g * g
            new = (v - rate * g / F.sqrt(summed + epsilon), m, summed)
        case "adam":
            first, second = a * m + (1 - a) * g, b * s + (1 - b) * g * g
            new = (v - rate * (first / (1 - a**step)) / (F.sqrt(second / (1 - b**step)) + epsilon), first, second)
        case _:
            raise ValueError(f"unknown rule {rule}")
    return parameters.select("i", "j", new[0].alias("v"), "g", new[1].alias("m"), new[2].alias("s"))


def one_hot_loss(truth: Column, predicted: Column) -> Column:
    """Mean categorical cross-entropy of two array columns."""
    log = F.transform(predicted, lambda p: F.ln(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))))
    return -F.avg(F.aggregate(F.zip_with(truth, log, lambda t, x: t * x), F.lit(0.0), lambda acc, v: acc + v))

