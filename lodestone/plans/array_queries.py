"""Arrays of three axes made of ``lineitem``: order, line, and one of three figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import arrays
from lodestone.plans.registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

# A line number may stand several times in an order: a cell is the sum of them.
_CELLS = "c AS (SELECT l_orderkey AS i, l_linenumber - 1 AS j, unnest([0, 1, 2]) AS k, unnest([sum(l_quantity), sum(l_extendedprice), sum(l_discount)])::DOUBLE AS v FROM lineitem GROUP BY l_orderkey, l_linenumber), n AS (SELECT max(i) + 1 AS ni, max(j) + 1 AS nj FROM c)"


#: Lines of a task, about: tasks grow in number with the table, not in memory.
LINES_AT_ONCE = 250_000


def _figures(spark: SparkSession, d: str) -> DataFrame:
    """Lines are dealt by order: sums over what an order or a line has need no other shuffle."""
    names, rows = ["l_quantity", "l_extendedprice", "l_discount"], table(spark, d, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // LINES_AT_ONCE))
    dealt = rows.select("l_orderkey", "l_linenumber", *names).repartition(tasks, "l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(*(F.sum(c).alias(c) for c in names))
    figures = F.array(*names)
    long = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"), F.posexplode(figures).alias("figure", "v"))
    return arrays.cells(long, [F.col("l_orderkey"), F.col("line"), F.col("figure")], F.col("v"))


def _extent(spark: SparkSession, d: str) -> tuple[int, ...]:
    """The shape of the array of figures, from places alone."""
    return (*arrays.shape(arrays.cells(table(spark, d, "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber") - 1], F.lit(0)), 2), 3)


def _shown(a: DataFrame, axes: int, digits: int = 4, *values: str) -> DataFrame:
    places = [F.get("at", F.lit(k)).alias(f"at{k}") for k in range(axes)]
    return a.select(*places, *((F.round(v, digits) + 0.0).alias(v) for v in values or ("v",)))


@query(f"WITH {_CELLS} SELECT CAST(k AS BIGINT) AS at0, CAST(i AS BIGINT) AS at1, CAST(j AS BIGINT) AS at2, round(v, 4) + 0.0 AS v FROM c")
def array_permuted(spark: SparkSession, d: str) -> DataFrame:
    """The last axis becomes the first."""
    return _shown(arrays.permuted(_figures(spark, d), [2, 0, 1]), 3)


def _over(gone: str, places: dict[str, str]) -> str:
    keys = ", ".join(f"CAST({c} AS BIGINT)" for c in places.values())
    return f"SELECT '{gone}' AS over, {', '.join(f'CAST({c} AS BIGINT) AS {n}' if c != 'NULL' else f'CAST(NULL AS BIGINT) AS {n}' for n, c in places.items())}, round(sum(v), 2) AS sum, round(min(v), 2) AS min, round(max(v), 2) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 5) AS std FROM c GROUP BY {keys}"


@query(f"WITH {_CELLS} " + " UNION ALL ".join([_over("0", {"at0": "j", "at1": "k"}), _over("1", {"at0": "i", "at1": "k"}), _over("0,1", {"at0": "k", "at1": "NULL"}), _over("-1", {"at0": "i", "at1": "j"})]))
def array_reduced(spark: SparkSession, d: str) -> DataFrame:
    """Sums, bounds, means and deviations over each axis, and over two at once."""
    a, found = _figures(spark, d), []
    for over in ([0], [1], [0, 1], [-1]):
        r = arrays.reduced(a, 3, over)
        figures = (F.round(c, {"mean": 6, "std": 5}.get(c, 2)).alias(c) for c in ("sum", "min", "max", "mean", "std"))
        found.append(r.select(F.lit(",".join(map(str, over))).alias("over"), *(F.get("at", F.lit(k)).alias(f"at{k}") for k in range(2)), *figures))
    return reduce(DataFrame.unionByName, found)


@query(f"""
WITH {_CELLS}
SELECT CAST((ni - 1 - i) // 2 AS BIGINT) AS at0, CAST(j - 1 AS BIGINT) AS at1, round(v, 4) + 0.0 AS v FROM c, n WHERE (ni - 1 - i) % 2 = 0 AND j BETWEEN 1 AND 3 AND k = 1
""")
def array_sliced(spark: SparkSession, d: str) -> DataFrame:
    """Every other order from the last one back, lines 1 to 3, the price alone."""
    a = _figures(spark, d)
    return _shown(arrays.taken(a, _extent(spark, d), [slice(None, None, -2), slice(1, 4), 1]), 2)


@query(f"""
WITH {_CELLS}, m AS (SELECT j, avg(v) AS mean FROM c WHERE k = 0 GROUP BY j)
SELECT CAST(i AS BIGINT) AS at0, CAST(c.j AS BIGINT) AS at1, CAST(k AS BIGINT) AS at2,
  round(CASE WHEN k = 0 AND i = ni - 1 THEN mean WHEN k = 2 AND i % 3 = 0 THEN -1 ELSE v END, 4) + 0.0 AS v FROM c JOIN m ON c.j = m.j, n
""")
def array_stored(spark: SparkSession, d: str) -> DataFrame:
    """A number put into every third order's discounts, then the mean of each line into the last order's quantities."""
    a = _figures(spark, d)
    extent = _extent(spark, d)
    means = arrays.reduced(arrays.taken(a, extent, [slice(None), slice(None), 0]), 2, [0]).select("at", F.col("mean").alias("v"))
    numbers = arrays.stored(a, extent, [slice(None, None, 3), slice(None), 2], -1.0)
    return _shown(arrays.stored(numbers, extent, [-1, slice(None), 0], means), 3)


@query(f"WITH {_CELLS}, f AS (SELECT (i * nj + j) * 3 + k AS f, v, nj FROM c, n) SELECT CAST(f // (nj * 3) AS BIGINT) AS at0, CAST(f % (nj * 3) AS BIGINT) AS at1, round(v, 4) + 0.0 AS v FROM f")
def array_reshaped(spark: SparkSession, d: str) -> DataFrame:
    """A row of all figures for each order."""
    a = _figures(spark, d)
    extent = _extent(spark, d)
    return _shown(arrays.reshaped(a, extent, (-1, extent[1] * extent[2])), 2)


@query(f"""
WITH {_CELLS}, m AS (SELECT j, k, avg(v) AS mean FROM c GROUP BY j, k), s AS (SELECT k, stddev_pop(v) AS std FROM c GROUP BY k)
SELECT CAST(i AS BIGINT) AS at0, CAST(c.j AS BIGINT) AS at1, CAST(c.k AS BIGINT) AS at2, round((v - mean) / std, 4) + 0.0 AS v FROM c JOIN m ON c.j = m.j AND c.k = m.k JOIN s ON c.k = s.k
""")
def array_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """Less the mean of each line and figure (two axes), by the deviation of each figure (one axis)."""
    a = _figures(spark, d)
    extent = _extent(spark, d)
    mean, std = (arrays.reduced(a, 3, over).select("at", F.col(of).alias("v")) for over, of in (([0], "mean"), ([0, 1], "std")))
    return _shown(arrays.combined(arrays.combined(a, mean, "-", extent, extent[1:]), std, "/", extent, extent[2:]), 3)


_UNITS = [0.02, 0.00001, 1.0]


@query(f"""
WITH {_CELLS}, s AS (SELECT i, j, k, v * {_UNITS}[k + 1]::DOUBLE AS v FROM c), g AS (SELECT a.k, b.k AS l, sum(a.v * b.v) AS w FROM s a JOIN s b ON a.i = b.i AND a.j = b.j GROUP BY a.k, b.k),
m AS (SELECT max(w) AS m FROM g)
SELECT CAST(i AS BIGINT) AS at0, CAST(j AS BIGINT) AS at1, CAST(l AS BIGINT) AS at2, round(sum(v * w / m), 6) + 0.0 AS v FROM s JOIN g ON s.k = g.k, m GROUP BY i, j, l
""")
def array_product(spark: SparkSession, d: str) -> DataFrame:
    """Every line's figures, in other units, times the summed products of figures with each other, which a single number divides."""
    a = _figures(spark, d)
    extent = _extent(spark, d)
    units = spark.createDataFrame([([k], u) for k, u in enumerate(_UNITS)], "at array<long>, v double")
    a = arrays.combined(a, units, "*", extent, extent[2:])
    products = arrays.gram(a, 3, extent[2])
    largest = arrays.reduced(products, 2, [0, 1]).select("at", F.col("max").alias("v"))
    return _shown(arrays.multiplied(a, arrays.combined(products, largest, "/", (extent[2], extent[2]), ()), 3, 2, (extent[2], extent[2])), 3, 6)
