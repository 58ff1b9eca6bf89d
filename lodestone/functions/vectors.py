"""Vector expressions on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Divided by its length plus a small number, so that a zero vector stays zero.

    The length is a variable of the lambda: named in it as an expression, it would be computed again for every number.
    """
    size = F.array(norm(a) + F.lit(EPSILON))
    return F.get(F.transform(size, lambda s: F.transform(a, lambda x: x.cast("double") / s)), F.lit(0))
