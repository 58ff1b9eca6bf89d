"""Networks trained by passes over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import networks


@pytest.mark.parametrize("activation", sorted(networks.ACTIVATIONS))
@pytest.mark.parametrize("loss", sorted(networks.LOSSES))
def test_slopes_are_those_of_the_loss(activation, loss):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(7, 4)), np.eye(3)[draw.integers(0, 3, 7)] * (2 if loss == "hinge" else 1) - (loss == "hinge")
    last = "sigmoid" if loss in ("binary", "categorical") else "linear"
    shapes, names = [(5, 5), (6, 3)], [activation, last]
    flat = draw.normal(size=5 * 5 + 6 * 3) * 0.4  # no sigmoid so near to 0 or 1 that differences lose their digits
    made = lambda v: networks.Network([v[:25].reshape(shapes[0]), v[25:].reshape(shapes[1])], names, [])
    _, slopes = made(flat).slopes(x, y, loss)
    near = np.eye(len(flat)) * 1e-6
    measured = [(made(flat + e).slopes(x, y, loss)[0] - made(flat - e).slopes(x, y, loss)[0]) / 2e-6 for e in near]
    assert np.allclose(slopes, measured, atol=1e-6)


def test_training_equals_numpy_and_leaves_out_odd_rows(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(200, 3))
    t = (x[:, :1] * x[:, 1:2] > 0).astype(float)
    rows = [(x[i].tolist(), t[i].tolist()) for i in range(200)]
    odd = [(None, [1.0]), ([1.0, 2.0, 3.0], None), ([1.0, None, 3.0], [1.0]), ([1.0, float("nan"), 3.0], [1.0]), ([1.0, 2.0], [1.0]), ([float("inf"), 0.0, 0.0], [0.0]), ([], [])]
    table = spark.createDataFrame(rows + odd, "x array<double>, t array<double>").repartition(5)
    how = dict(sizes=[3, 8, 1], activations=["tanh", "sigmoid"], loss="binary", epochs=15, rule="adam", rate=0.1, seed=2)
    got = networks.train(table, "x", "t", **how)
    want, m, s = networks.Network(networks.starting(spark, [3, 8, 1], seed=2), ["tanh", "sigmoid"], []), 0.0, 0.0
    for step in range(1, 16):
        cost, g = want.slopes(x, t, "binary")
        want.losses.append(cost / 200)
        g = g / 200
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        flat = np.concatenate([w.ravel() for w in want.weights]) - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        want = networks.Network([flat[:32].reshape(4, 8), flat[32:].reshape(9, 1)], want.activations, want.losses)
    assert np.allclose(got.losses, want.losses) and got.losses[-1] < got.losses[0]
    assert all(np.allclose(a, b) for a, b in zip(got.weights, want.weights, strict=True))
    said = [r.p for r in table.coalesce(1).select("x", "t", networks.scores(F.col("x"), got).alias("p")).collect()]
    assert sum(p is None for p in said) == 6  # the row without a target has a score
    assert sorted(round(p[0], 9) for p in said if p)[0] == round(min(want.outputs(np.vstack([x, [[1, 2, 3]]]))[-1])[0], 9)


def test_no_rows_no_label_and_ties(spark):
    none = spark.createDataFrame([], "x array<double>, t array<double>")
    kept = networks.train(none, "x", "t", [2, 2], ["linear"], "squared", 3, initial=None)
    assert kept.losses == [] and not kept.weights[0].any()
    with pytest.raises(ValueError):
        networks.train(none, "x", "t", [2, 2], ["linear", "linear"], "squared", 3)
    df = spark.createDataFrame([(0,), (2,), (3,), (-1,), (None,)], "k int")
    got = df.select("k", networks.one_of(F.col("k"), 3, -1.0).alias("a")).collect()
    assert [r.a for r in got] == [[1.0, -1.0, -1.0], [-1.0, -1.0, 1.0], None, None, None]
    tied = spark.createDataFrame([([0.5, 0.7, 0.7],), (None,)], "p array<double>").select(networks.largest(F.col("p")).alias("k"))
    assert [r.k for r in tied.collect()] == [1, None]
