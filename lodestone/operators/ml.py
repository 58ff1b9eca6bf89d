"""Numerical operators on tables: scaling, tokenizing, clustering, trees, regression, losses, activations, matrices.

Matrices are ``(i, j, v)`` rows; feature rows are columns of doubles or arrays.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.vectors import dot
from lodestone.plans.lineage import written

SMALL = 1e-10


# --- running figures without one task for all ----------------------------------------------


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` dealt to ranges of ``order`` and written, with ``__part``: rows of a smaller part come first."""
    return written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], sums: dict[str, str], within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with running sums (``new name: column``) in ``order``, within each value of ``within``.

    Every range sums its own rows; what stands before it, one row per range, is added.
    """
    dealt, own = in_ranges(df, *within, *order), [*within, "__part"]
    part = dealt.groupBy(*own).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    up = W.partitionBy(*within or [F.lit(0)]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = part.select(*own, *(F.coalesce(F.sum(n).over(up), F.lit(0)).alias(f"__before_{n}") for n in sums))
    here = W.partitionBy(*own).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = {n: F.sum(c).over(here) + F.col(f"__before_{n}") for n, c in sums.items()}
    return dealt.join(before, own).withColumns(total).drop("__part", *(f"__before_{n}" for n in sums))


# --- scaling -------------------------------------------------------------------------------


def safe_ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is nearly 0."""
    return F.when(F.abs(b) < SMALL, 0.0).otherwise(a / F.nullif(b, F.lit(0.0)))


def standard_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0."""
    stats = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


def minmax_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """From 0 to 1; a constant column becomes 0."""
    stats = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))))
    scaled = {c: safe_ratio(F.col(c) - F.col(f"__a_{c}"), F.col(f"__b_{c}") - F.col(f"__a_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


# --- tokenizing ----------------------------------------------------------------------------

PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalised_text(c: Column | str, lower: bool = True, punctuation: bool = True, spaces: bool = True) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    out = F.lower(out) if lower else out
    out = F.regexp_replace(out, PUNCTUATION, " ") if punctuation else out
    return F.trim(F.regexp_replace(out, r"\s+", " ")) if spaces else out


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda w: w != "")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``token, id`` of ``tokens(token)``: pad 0, unknown 1, then tokens in order."""
    distinct = tokens.select("token").distinct().withColumn("one", F.lit(1))
    numbered = running(distinct, ["token"], {"id": "one"}).select("token", (F.col("id") + 1).cast("long").alias("id"))
    fixed = tokens.sparkSession.createDataFrame([("<pad>", 0), ("<unk>", 1)], "token string, id long")
    return fixed.unionByName(numbered)


def encoded(rows: DataFrame, key: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """``key, pos, id``; tokens that the vocabulary lacks are unknown."""
    each = rows.select(key, F.posexplode(tokens).alias("pos", "token"))
    return each.join(vocab, "token", "left").select(key, "pos", F.coalesce("id", F.lit(1)).alias("id"))


def decoded(ids: DataFrame, key: str, vocab: DataFrame, joiner: str = " ") -> DataFrame:
    """``key, text`` of ``ids(key, pos, id)``."""
    named = ids.join(vocab, "id", "left").select(key, "pos", F.coalesce("token", F.lit("<unk>")).alias("token"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda p: p["token"])
    return named.groupBy(key).agg(F.array_join(parts, joiner).alias("text"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """``left, right, n``: neighbouring symbols of ``pieces(symbols, n)``, weighted by how often each word occurs."""
    zipped = F.arrays_zip(F.slice("symbols", 1, F.greatest(F.size("symbols") - 1, F.lit(0))).alias("l"), F.slice("symbols", 2, F.greatest(F.size("symbols") - 1, F.lit(0))).alias("r"))
    pairs = pieces.select("n", F.explode(zipped).alias("p"))
    return pairs.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("n").alias("n"))


def wordpiece_scores(pieces: DataFrame) -> DataFrame:
    """``left, right, n, score``: pair count over the product of its symbols' counts."""
    single = pieces.select("n", F.explode("symbols").alias("s")).groupBy("s").agg(F.sum("n").alias("c"))
    both = pair_counts(pieces).join(single.select(F.col("s").alias("left"), F.col("c").alias("cl")), "left").join(single.select(F.col("s").alias("right"), F.col("c").alias("cr")), "right")
    return both.select("left", "right", "n", (F.col("n") / (F.col("cl") * F.col("cr"))).alias("score"))


def merged(pieces: DataFrame, left: str, right: str, token: str) -> DataFrame:
    """``pieces`` with every occurrence of the pair replaced by ``token``, from the left."""
    start = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        init = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((last == left) & (s == right), F.array_append(init, F.lit(token))).otherwise(F.array_append(acc, s))

    return pieces.withColumn("symbols", F.aggregate("symbols", start, step))


def fit_merges(pieces: DataFrame, rounds: int, wordpiece: bool = False, least: int = 2, prefix: str = "##") -> list[tuple[str, str, str]]:
    """Merges learned from a table of distinct words: each round one aggregation; the driver sees one row of it.

    Ties go to the smaller pair.
    """
    out: list[tuple[str, str, str]] = []
    pieces = written(pieces.select("symbols", "n"))
    for _ in range(rounds):
        order = [F.desc("score" if wordpiece else "n"), "left", "right"]
        best = (wordpiece_scores(pieces) if wordpiece else pair_counts(pieces)).orderBy(*order).limit(1).collect()
        if not best or (not wordpiece and best[0]["n"] < least):
            break
        left, right = best[0]["left"], best[0]["right"]
        token = left + (right.removeprefix(prefix) if wordpiece else right)
        out.append((left, right, token))
        pieces = written(merged(pieces, left, right, token))
    return out


def apply_merges(pieces: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """Merges in the order in which they were learned, on the table of distinct words."""
    return reduce(lambda p, m: merged(p, *m), merges, pieces)


def byte_symbols(words: DataFrame) -> DataFrame:
    """``word, n, symbols`` of ``words(word, n)``: the bytes of each word's UTF-8, as two hexadecimal digits each."""
    return words.select("word", "n", F.regexp_extract_all(F.hex(F.encode("word", "utf-8")), F.lit("(..)"), F.lit(1)).alias("symbols"))


def wordpiece_vocabulary(pieces: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """``piece``: the symbols of ``pieces`` and what their merges made."""
    symbols = pieces.select(F.explode("symbols").alias("piece")).distinct()
    made = pieces.sparkSession.createDataFrame([(t,) for _, _, t in merges], "piece string")
    return symbols.unionByName(made).distinct()


def wordpiece(words: DataFrame, vocab: DataFrame, prefix: str = "##", unknown: str = "<unk>") -> DataFrame:
    """``word, pieces`` of distinct ``words(word)``: the longest piece of ``vocab(piece)`` at each place, from the left.

    A word with a place where nothing fits is one unknown piece; pieces inside a word carry ``prefix``.
    Substrings meet the vocabulary in an equi-join, and a fold walks along the longest ones.
    """
    vocab = written(vocab.select("piece").distinct())
    longest = vocab.agg(F.coalesce(F.max(F.length("piece")), F.lit(0))).first()[0]
    starts = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at")).filter("word <> ''")
    ends = F.sequence(F.col("at") + 1, F.least(F.length("word"), F.col("at") + longest))
    tried = starts.select("word", "at", F.explode(ends).alias("end"))
    text = F.substr("word", F.col("at") + 1, F.col("end") - F.col("at"))
    tried = tried.withColumn("piece", F.when(F.col("at") > 0, F.concat(F.lit(prefix), text)).otherwise(text))
    best = tried.join(vocab, "piece").groupBy("word", "at").agg(F.max(F.struct("end", "piece")).alias("m"))
    steps = best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "m.end", "m.piece"))).alias("steps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        taken = F.struct(s["end"].cast("int").alias("at"), F.array_append(acc["out"], s["piece"]).alias("out"))
        return F.when(s["at"] == acc["at"], taken).otherwise(acc)

    walked = words.join(steps, "word", "left").withColumn("walk", F.aggregate(F.coalesce("steps", F.array().cast("array<struct<at:int,end:int,piece:string>>")), start, step))
    whole = F.col("walk.at") == F.length("word")
    return walked.select("word", F.when(whole, F.col("walk.out")).otherwise(F.array(F.lit(unknown))).alias("pieces"))


# --- clustering ----------------------------------------------------------------------------


#: Centres compared with a row at once; more go in blocks, so what is broadcast stays bounded.
CENTRES_AT_ONCE = 4096


def assign_clusters(points: DataFrame, centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, vector, cluster, distance``: nearest of the centroids (``cluster, centre``), ties to the smaller.

    Centres come as one broadcast row for each CENTRES_AT_ONCE of them, so a point never leaves its task.
    """
    blocks = max(1, -(-centroids.count() // CENTRES_AT_ONCE))
    dealt = centroids.withColumn("__block", F.pmod(F.xxhash64("cluster"), F.lit(blocks)))

    def near(c: Column) -> Column:
        gap = F.zip_with(vector, c["centre"], lambda a, b: a.cast("double") - b)
        return F.struct(F.sqrt(dot(gap, gap)).alias("distance"), c["cluster"].alias("cluster"))

    rows = points.select(key, vector, F.lit(None).alias("__best"))
    for i in range(blocks):  # a point carries the nearest centre so far, never the blocks
        block = dealt.filter(F.col("__block") == i).agg(F.collect_list(F.struct("cluster", "centre")).alias("__centres"))
        nearest = F.array_min(F.transform("__centres", near))
        best = nearest if not i else F.least(F.coalesce("__best", nearest), F.coalesce(nearest, F.col("__best")))
        rows = rows.crossJoin(F.broadcast(block)).select(key, vector, best.alias("__best"))
    return rows.select(key, vector, "__best.cluster", "__best.distance")


def kmeans_start(points: DataFrame, k: int, key: str, vector: str, seed: int = 0) -> DataFrame:
    """``cluster, centre``: ``k`` distinct rows drawn by a hash of seed and key, so every run draws the same."""
    drawn = points.select(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("__h"), key, vector).orderBy("__h", key).limit(k)
    number = (F.row_number().over(W.orderBy("__h", key)) - 1).alias("cluster")
    return written(drawn.select(number, F.transform(vector, lambda x: x.cast("double")).alias("centre")))


def move_centroids(assigned: DataFrame, centroids: DataFrame, vector: str) -> DataFrame:
    """``cluster, centre``: means of the members; an empty cluster keeps its centre."""
    means = assigned.select("cluster", F.posexplode(vector).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    new = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("new"))
    return centroids.join(new, "cluster", "left").select("cluster", F.coalesce("new", "centre").alias("centre"))


def kmeans(points: DataFrame, centroids: DataFrame, key: str, vector: str, rounds: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """Centroids after Lloyd's rounds from a given start; the driver holds the few centroids between rounds."""
    spark, held = points.sparkSession, centroids
    for _ in range(rounds):
        moved = move_centroids(assign_clusters(points, held, key, vector), held, vector)
        both = held.join(moved.withColumnRenamed("centre", "next"), "cluster").collect()
        held = spark.createDataFrame([(r["cluster"], r["next"]) for r in both], held.schema)
        if sum(sum((a - b) ** 2 for a, b in zip(r["centre"], r["next"], strict=True)) ** 0.5 for r in both) < tolerance:
            break
    return held


# --- trees ---------------------------------------------------------------------------------


def best_splits(
    rows: DataFrame, features: list[str], label: str, classes: list[float] | None = None, node: str | None = None,
    weight: str | None = None, allowed: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``node, feature, threshold, gain``: for each node the split ``x <= threshold`` of most gain.

    Gain is that of entropy over ``classes``, or of squared error where there are none.  Every distinct value is
    tried; sums run along ranges of values, all features and nodes in one pass.  Ties go to the first feature, then
    the smaller value.  Null values of a feature and null labels are left out.  A row counts ``weight`` times, once
    without it; of a node only features (by number) that are ``allowed(node, feature)`` are tried, all without it.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    y, at = F.col(label).cast("double"), F.lit(0) if node is None else F.col(node)
    values = F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(features)))
    long = rows.select(at.alias("node"), y.alias("y"), times.alias("w"), F.explode(values).alias("v")).select("node", "y", "w", "v.f", "v.x").filter("x IS NOT NULL AND y IS NOT NULL")
    if classes is None:
        kept = {"s0": F.sum(F.col("w") * F.col("y")), "s1": F.sum(F.col("w") * F.col("y") * F.col("y"))}
    else:
        kept = {f"s{k}": F.sum(F.when(F.col("y") == float(c), F.col("w")).otherwise(0)) for k, c in enumerate(classes)}
    names = ["n", *kept]
    # Written, for it is read three times; and what is asked of nodes and features is else asked of every row below.
    by_value = written(long.groupBy("node", "f", "x").agg(F.sum("w").alias("n"), *(c.alias(k) for k, c in kept.items())))
    whole = by_value.groupBy("node", "f").agg(*(F.sum(n).alias(f"t_{n}") for n in names))
    if allowed is not None:
        whole = written(written(whole).filter(allowed(F.col("node"), F.col("f"))))
        by_value = by_value.join(whole, ["node", "f"], "left_semi")
    c = running(by_value, ["x"], {f"l_{n}": n for n in names}, ("node", "f"))
    c = c.join(whole, ["node", "f"]).filter("l_n < t_n")

    def impurity(n: Column, of: list[Column]) -> Column:
        if classes is None:
            return of[1] / n - (of[0] / n) * (of[0] / n)
        return -reduce(lambda a, b: a + b, (F.when(q > 0, q * F.log2(q)).otherwise(0.0) for q in (x / n for x in of)))

    left, total = ([F.col(f"{side}_{k}") for k in kept] for side in "lt")
    n, nl = F.col("t_n"), F.col("l_n")
    right = [b - a for a, b in zip(left, total, strict=True)]
    gain = impurity(n, total) - nl / n * impurity(nl, left) - (n - nl) / n * impurity(n - nl, right)
    tried = c.withColumn("gain", F.round(gain, 12)).withColumn("feature", F.get(F.array(*map(F.lit, features)), F.col("f")))
    best = tried.groupBy("node").agg(F.min_by(F.struct("feature", F.col("x").alias("threshold"), "gain"), F.struct(-F.col("gain"), "f", "x")).alias("b"))
    return best.select("node", "b.*")


def best_split(rows: DataFrame, features: list[str], label: str, classes: list[float] | None = (0.0, 1.0)) -> DataFrame:
    """``feature, threshold, gain`` of all rows as one node, over binary labels unless other ``classes`` are given."""
    return best_splits(rows, features, label, classes and list(classes)).drop("node")


def majority(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """``key, vote``: the most frequent vote, ties to the smaller."""
    counts = votes.groupBy(key, vote).count()
    return counts.groupBy(key).agg(F.min_by(vote, F.struct(-F.col("count"), F.col(vote))).alias(vote))


# --- regression ----------------------------------------------------------------------------


def predicted(features: list[Column], weights: list[float], bias: float) -> Column:
    return reduce(lambda a, b: a + b, (x * F.lit(w) for x, w in zip(features, weights, strict=True))) + F.lit(bias)


def polynomial(columns: list[str], degree: int) -> list[tuple[str, Column]]:
    """All monomials of degree 1 to ``degree`` with repetition, by degree, then in order of the columns."""
    combos = (c for d in range(1, degree + 1) for c in itertools.combinations_with_replacement(columns, d))
    return [("_".join(c), reduce(lambda a, b: a * b, map(F.col, c))) for c in combos]


def fit_linear(rows: DataFrame, features: list[str], target: str, steps: int, rate: float, loss: str = "squared", margin: float = 0.1, decay: float = 0.0) -> tuple[list[float], float, list[float]]:
    """Gradient descent from zero: weights, bias, losses; one aggregation a step.

    ``loss`` is ``squared``, ``hinge`` (targets -1 and 1: a linear support vector machine) or ``insensitive``
    (errors up to ``margin`` cost nothing: support vector regression); ``decay`` shrinks the weights.
    """
    w, b, losses = [0.0] * len(features), 0.0, []
    y = F.col(target)
    for _ in range(steps):
        p = predicted([F.col(f) for f in features], w, b)
        err = p - y
        match loss:
            case "squared":
                cost, slope = err * err, 2 * err
            case "hinge":
                cost, slope = F.greatest(1 - y * p, F.lit(0.0)), F.when(y * p < 1, -y).otherwise(0.0)
            case "insensitive":
                cost, slope = F.greatest(F.abs(err) - margin, F.lit(0.0)), F.when(F.abs(err) > margin, F.signum(err)).otherwise(0.0)
            case _:
                raise ValueError(f"unknown loss {loss}")
        got = rows.agg(F.avg(cost).alias("loss"), F.avg(slope).alias("b"), *(F.avg(slope * F.col(f)).alias(f"w{i}") for i, f in enumerate(features))).first()
        if got["loss"] is None:
            break
        losses.append(got["loss"])
        w, b = [x - rate * (got[f"w{i}"] + decay * x) for i, x in enumerate(w)], b - rate * got["b"]
    return w, b, losses


# --- losses, scores, activations -----------------------------------------------------------


def losses(y: Column, p: Column, delta: float = 1.0) -> dict[str, Column]:
    """Aggregates of truth and prediction."""
    e, q = p - y, F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    huber = F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))
    return {"mse": F.avg(e * e), "mae": F.avg(F.abs(e)), "bce": -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q)), "huber": F.avg(huber)}


def r2(rows: DataFrame, y: str, p: str) -> DataFrame:
    """``r2, mse, mae`` from one pass of sums."""
    n, e = F.count("*"), F.col(p) - F.col(y)
    total = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return rows.agg((1 - F.sum(e * e) / total).alias("r2"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def activations(x: Column, alpha: float = 0.01) -> dict[str, Column]:
    e = F.exp(-x)
    return {
        "relu": F.greatest(x, F.lit(0.0)),
        "leaky_relu": F.when(x > 0, x).otherwise(alpha * x),
        "elu": F.when(x > 0, x).otherwise(F.exp(x) - 1),
        "sigmoid": 1 / (1 + e),
        "tanh": F.tanh(x),
        "linear": x,
    }


def softmax(x: Column) -> Column:
    """Of an array; its largest element is subtracted first."""
    e = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double")))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y))


# --- matrices ------------------------------------------------------------------------------


def coo(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.select(F.col(key).alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), "v"), b.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def reduced(m: DataFrame, axis: str) -> DataFrame:
    """``sum, min, max, mean, std`` (population) over the index that is not ``axis``."""
    return m.groupBy(axis).agg(F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def reshaped(m: DataFrame, columns: int, new_columns: int) -> DataFrame:
    flat = F.col("i") * columns + F.col("j")
    return m.select(F.floor(flat / new_columns).alias("i"), (flat % new_columns).alias("j"), "v")


def elementwise(a: DataFrame, b: DataFrame, op: str, over: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """``a op b`` cell by cell; ``b`` varies over the indices ``over`` only: both, ``i`` (a column), ``j`` (a row) or none (a scalar).

    A division by nearly zero gives 0.
    """
    right = b.select(*over, F.col("v").alias("__w"))
    rows = a.join(right, list(over)) if over else a.crossJoin(F.broadcast(right.limit(1)))
    x, y = F.col("v"), F.col("__w")
    found = {"+": x + y, "-": x - y, "*": x * y, "/": safe_ratio(x, y), "**": F.pow(x, y)}[op]
    return rows.select("i", "j", found.alias("v"))


def mapped(m: DataFrame, function: str) -> DataFrame:
    """A function of every cell: ``sqrt``, ``exp``, ``log`` or ``abs``."""
    v = F.col("v")
    return m.select("i", "j", {"sqrt": F.sqrt(v), "exp": F.exp(v), "log": F.ln(v), "abs": F.abs(v)}[function].alias("v"))


def filled(spark: SparkSession, rows: int, columns: int, value: Column | float) -> DataFrame:
    """A matrix of one value (0, 1, ...) or of an expression of ``i`` and ``j``."""
    cells = spark.range(rows * columns).select(F.expr(f"id div {columns}").alias("i"), (F.col("id") % columns).alias("j"))
    return cells.select("i", "j", (value if isinstance(value, Column) else F.lit(float(value))).alias("v"))
