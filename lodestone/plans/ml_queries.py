"""Numerical operators on the sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import learners, ml, networks
from lodestone.plans.registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS q FROM lineitem, s
""")
def scale_standard(spark: SparkSession, d: str) -> DataFrame:
    scaled = ml.standard_scaled(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])
    return scaled.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("q"))


@query("""
WITH s AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)
SELECT p_partkey, round((p_retailprice - a) / (b - a), 6) AS price FROM part, s
""")
def scale_minmax(spark: SparkSession, d: str) -> DataFrame:
    scaled = ml.minmax_scaled(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])
    return scaled.select("p_partkey", F.round("p_retailprice", 6).alias("price"))


_TEXT = r"norm AS (SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM benchmark)"
_WORDS = f"{_TEXT}, words AS (SELECT item_id, unnest(string_split(t, ' ')) AS token FROM norm WHERE t <> '')"
_VOCAB = f"{_WORDS}, vocab AS (SELECT '<pad>' AS token, 0 AS id UNION ALL SELECT '<unk>', 1 UNION ALL SELECT token, row_number() OVER (ORDER BY encode(token)) + 1 FROM (SELECT DISTINCT token FROM words))"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", ml.words(ml.normalised_text("text")).alias("tokens"))


@query(f"WITH {_TEXT} SELECT item_id, t AS text FROM norm")
def tok_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", ml.normalised_text("text").alias("text"))


@query(f"WITH {_VOCAB} SELECT token, CAST(id AS BIGINT) AS id FROM vocab")
def tok_word_vocab(spark: SparkSession, d: str) -> DataFrame:
    return ml.vocabulary(_words(spark, d).select(F.explode("tokens").alias("token")))


@query(f"""
WITH {_TEXT}, c AS (SELECT DISTINCT unnest(string_split(t, '')) AS token FROM norm)
SELECT '<pad>' AS token, CAST(0 AS BIGINT) AS id UNION ALL SELECT '<unk>', 1 UNION ALL SELECT token, row_number() OVER (ORDER BY encode(token)) + 1 FROM c WHERE token <> ''
""")
def tok_char_vocab(spark: SparkSession, d: str) -> DataFrame:
    chars = table(spark, d, "benchmark").select(F.explode(ml.characters(ml.normalised_text("text"))).alias("token"))
    return ml.vocabulary(chars)


@query(f"""
WITH {_VOCAB}, w AS (SELECT item_id, unnest(range(len(a))) AS pos, unnest(a) AS token FROM (SELECT item_id, string_split(t, ' ') AS a FROM norm WHERE t <> ''))
SELECT item_id, CAST(pos AS INTEGER) AS pos, CAST(coalesce(id, 1) AS BIGINT) AS id FROM w LEFT JOIN vocab ON w.token = vocab.token
""")
def tok_word_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = _words(spark, d)
    return ml.encoded(rows, "item_id", "tokens", tok_word_vocab(spark, d))


@query(f"WITH {_WORDS} SELECT item_id, string_agg(token, ' ') AS text FROM words GROUP BY item_id")
def tok_decode(spark: SparkSession, d: str) -> DataFrame:
    return ml.decoded(tok_word_ids(spark, d), "item_id", tok_word_vocab(spark, d))


def _pieces(spark: SparkSession, d: str, mark: str) -> DataFrame:
    counts = _words(spark, d).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    symbols = F.transform(ml.characters(F.col("word")), lambda c, i: F.when(i > 0, F.concat(F.lit(mark), c)).otherwise(c))
    return counts.select("word", "n", symbols.alias("symbols"))


_PAIRS = """
counts AS (SELECT token AS word, count(*) AS n FROM words GROUP BY token),
symbols AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM counts),
sym AS (SELECT word, n, i, CASE WHEN i > 1 THEN '{m}' ELSE '' END || substr(word, i, 1) AS s FROM symbols),
pairs AS (SELECT a.s AS "left", b.s AS "right", sum(a.n) AS n FROM sym a JOIN sym b ON a.word = b.word AND b.i = a.i + 1 GROUP BY a.s, b.s)
"""


@query(f'WITH {_WORDS}, {_PAIRS.format(m="")} SELECT "left", "right", CAST(n AS BIGINT) AS n FROM pairs')
def bpe_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return ml.pair_counts(_pieces(spark, d, ""))


@query(f"""
WITH {_WORDS}, {_PAIRS.format(m="##")}, one AS (SELECT s, sum(n) AS c FROM sym GROUP BY s)
SELECT p."left", p."right", CAST(p.n AS BIGINT) AS n, round(CAST(p.n AS DOUBLE) / (CAST(a.c AS DOUBLE) * CAST(b.c AS DOUBLE)), 9) AS score
FROM pairs p JOIN one a ON p."left" = a.s JOIN one b ON p."right" = b.s
""")
def wordpiece_scores(spark: SparkSession, d: str) -> DataFrame:
    return ml.wordpiece_scores(_pieces(spark, d, "##")).withColumn("score", F.round("score", 9))


def _merge_rounds(start: str, rounds: int, wordpiece: bool = False) -> str:
    """SQL tables ``r0 ... rN`` of words, symbols as `` s `` each, and ``b1 ... bN`` of the pair merged in each round."""
    out = [f"r0 AS ({start})"]
    for i in range(1, rounds + 1):
        out.append(f"y{i} AS (SELECT n, string_split(substr(s, 2, length(s) - 2), '  ') AS a FROM r{i - 1} WHERE s <> '')")
        out.append(f"x{i} AS (SELECT n, unnest(list_zip(a[:len(a) - 1], a[2:])) AS p FROM y{i} WHERE len(a) > 1)")
        out.append(f"q{i} AS (SELECT p[1] AS l, p[2] AS r, sum(n)::DOUBLE AS n FROM x{i} GROUP BY ALL)")
        if wordpiece:
            out.append(f"o{i} AS (SELECT s, sum(n)::DOUBLE AS c FROM (SELECT n, unnest(a) AS s FROM y{i}) GROUP BY s)")
            out.append(f"b{i} AS (SELECT l, r, l || CASE WHEN starts_with(r, '##') THEN substr(r, 3) ELSE r END AS t FROM q{i} JOIN o{i} a ON l = a.s JOIN o{i} z ON r = z.s ORDER BY q{i}.n / (a.c * z.c) DESC, l, r LIMIT 1)")
        else:
            out.append(f"b{i} AS (SELECT l, r, l || r AS t FROM q{i} WHERE n >= 2 ORDER BY n DESC, l, r LIMIT 1)")
        out.append(f"r{i} AS (SELECT word, n, coalesce(replace(s, ' ' || l || '  ' || r || ' ', ' ' || t || ' '), s) AS s FROM r{i - 1} LEFT JOIN b{i} ON true)")
    return ",\n".join(out)


_COUNTED = f"{_WORDS}, counts AS (SELECT token AS word, count(*) AS n FROM words GROUP BY token)"
_CHARS = "SELECT word, n, ' ' || array_to_string(string_split(word, ''), '  ') || ' ' AS s FROM counts"
_BYTES = "SELECT word, n, regexp_replace(hex(encode(word)), '(..)', ' \\1 ', 'g') AS s FROM counts"
_MARKED = "SELECT word, n, ' ' || array_to_string(list_transform(string_split(word, ''), lambda x, i: CASE WHEN i > 1 THEN '##' ELSE '' END || x), '  ') || ' ' AS s FROM counts"
_MERGED = "SELECT word, replace(substr(s, 2, length(s) - 2), '  ', ' ') AS symbols FROM"
_LEARNED = " UNION ALL ".join(f'SELECT {i} AS round, l AS "left", r AS "right", t AS token FROM b{i}' for i in range(1, 7))


def _merges(spark: SparkSession, merges: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges, 1)], 'round int, left string, right string, token string')


@query(f"WITH {_COUNTED}, {_merge_rounds(_CHARS, 6)} {_MERGED} r6")
def bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    """Words encoded by a few merges learned from the same table."""
    pieces = _pieces(spark, d, "")
    return ml.apply_merges(pieces, ml.fit_merges(pieces, 6)).select("word", F.array_join("symbols", " ").alias("symbols"))


def _byte_pieces(spark: SparkSession, d: str) -> DataFrame:
    return ml.byte_symbols(_words(spark, d).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")))


@query(f"WITH {_COUNTED}, {_merge_rounds(_BYTES, 6)} {_LEARNED}")
def bpe_fit_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Merges of UTF-8 bytes, most frequent pair first."""
    return _merges(spark, ml.fit_merges(_byte_pieces(spark, d), 6))


@query(f"WITH {_COUNTED}, {_merge_rounds(_BYTES, 6)} {_MERGED} r6")
def bpe_transform_bytes(spark: SparkSession, d: str) -> DataFrame:
    pieces = _byte_pieces(spark, d)
    return ml.apply_merges(pieces, ml.fit_merges(pieces, 6)).select("word", F.array_join("symbols", " ").alias("symbols"))


@query(f"WITH {_COUNTED}, {_merge_rounds(_MARKED, 6, True)} {_LEARNED}")
def wordpiece_fit(spark: SparkSession, d: str) -> DataFrame:
    return _merges(spark, ml.fit_merges(_pieces(spark, d, "##"), 6, wordpiece=True))


@query(f"""
WITH RECURSIVE {_COUNTED}, {_merge_rounds(_CHARS, 6)},
v AS (SELECT DISTINCT unnest(string_split(substr(s, 2, length(s) - 2), '  ')) AS piece FROM r0 UNION SELECT t FROM b1 UNION SELECT t FROM b2 UNION SELECT t FROM b3 UNION SELECT t FROM b4 UNION SELECT t FROM b5 UNION SELECT t FROM b6),
u AS (SELECT piece FROM v UNION SELECT '##' || piece FROM v WHERE piece <> 'e'),
tried AS (SELECT word, pos, len, substr(word, pos, len) AS p FROM (SELECT word, pos, unnest(range(1, length(word) - pos + 2)) AS len FROM (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM counts))),
best AS (SELECT word, pos, max(len) AS len FROM tried JOIN u ON u.piece = CASE WHEN pos > 1 THEN '##' ELSE '' END || p GROUP BY word, pos),
walk AS (
  SELECT word, CAST(1 AS BIGINT) AS pos, '' AS out FROM counts
  UNION ALL
  SELECT w.word, w.pos + b.len, w.out || CASE WHEN w.pos > 1 THEN ' ##' ELSE '' END || substr(w.word, w.pos, b.len) FROM walk w JOIN best b ON w.word = b.word AND w.pos = b.pos
),
whole AS (SELECT word, out FROM walk WHERE pos = length(word) + 1)
SELECT c.word, coalesce(out, '<unk>') AS pieces FROM counts c LEFT JOIN whole ON c.word = whole.word
""")
def wordpiece_transform(spark: SparkSession, d: str) -> DataFrame:
    """Longest pieces from the left; the vocabulary lacks an inner e, so words with one beyond a longer piece are unknown."""
    pieces = _pieces(spark, d, "")
    plain = ml.wordpiece_vocabulary(pieces, ml.fit_merges(pieces, 6))
    inner = plain.filter("piece <> 'e'").select(F.concat(F.lit("##"), "piece").alias("piece"))
    return ml.wordpiece(pieces.select("word"), plain.unionByName(inner)).select("word", F.array_join("pieces", " ").alias("pieces"))


_POINTS = """
p AS (SELECT vec_id, label, unnest(range(len(embedding))) AS j, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings),
c AS (SELECT label AS cluster, j, avg(x) AS x FROM p GROUP BY label, j),
dist AS (SELECT p.vec_id, c.cluster, sqrt(sum((p.x - c.x) * (p.x - c.x))) AS d FROM p JOIN c ON p.j = c.j GROUP BY p.vec_id, c.cluster),
near AS (SELECT vec_id, cluster, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS n FROM dist)
"""


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centre"))


@query(f"WITH {_POINTS} SELECT vec_id, cluster, round(d, 6) AS distance FROM near WHERE n = 1")
def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    found = ml.assign_clusters(table(spark, d, "embeddings"), _centroids(spark, d), "vec_id", "embedding")
    return found.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query(f"WITH {_POINTS} SELECT n.cluster, CAST(p.j AS INTEGER) AS pos, round(avg(p.x), 6) AS x FROM near n JOIN p ON n.vec_id = p.vec_id WHERE n.n = 1 GROUP BY n.cluster, p.j")
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    start = _centroids(spark, d)
    moved = ml.move_centroids(ml.assign_clusters(table(spark, d, "embeddings"), start, "vec_id", "embedding"), start, "embedding")
    return moved.select("cluster", F.posexplode("centre").alias("pos", "x")).withColumn("x", F.round("x", 6))


def _lloyd(rounds: int) -> str:
    out = ["c0 AS (SELECT row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS cluster, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 5)", "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"]
    for i in range(rounds):
        out.append(f"d{i} AS (SELECT vec_id, e, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), cluster) AS k FROM e, c{i})")
        out.append(f"m{i} AS (SELECT cluster, j, avg(x) AS x FROM (SELECT cluster, unnest(range(64)) AS j, unnest(e) AS x FROM d{i} WHERE k = 1) GROUP BY ALL)")
        out.append(f"c{i + 1} AS (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT cluster, list(x ORDER BY j) AS c FROM m{i} GROUP BY cluster) n ON o.cluster = n.cluster)")
    return ",\n".join(out)


@query(f"WITH {_lloyd(0)} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(c), 6) AS x FROM c0")
def kmeans_start(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rows, drawn at random by a hash."""
    start = ml.kmeans_start(table(spark, d, "embeddings"), 5, "vec_id", "embedding", seed=7)
    return start.select("cluster", F.posexplode("centre").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_lloyd(4)} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(c), 6) AS x FROM c4")
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings")
    found = ml.kmeans(points, ml.kmeans_start(points, 5, "vec_id", "embedding", seed=7), "vec_id", "embedding", rounds=4, tolerance=0.0)
    return found.select("cluster", F.posexplode("centre").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""
WITH r AS (SELECT CAST(n_chars AS DOUBLE) AS x, CAST(quality AS DOUBLE) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
v AS (SELECT x, count(*) AS n, sum(y) AS p FROM r GROUP BY x),
c AS (SELECT x, sum(n) OVER (ORDER BY x) AS nl, sum(p) OVER (ORDER BY x) AS pl, sum(n) OVER () AS n, sum(p) OVER () AS p FROM v),
q AS (SELECT x, nl, n - nl AS nr, n, p / n AS q0, pl / nl AS q1, (p - pl) / nullif(n - nl, 0) AS q2 FROM c WHERE nl < n),
e AS (SELECT x, nl, nr, n,
  -(CASE WHEN q0 > 0 THEN q0 * log2(q0) ELSE 0 END + CASE WHEN q0 < 1 THEN (1 - q0) * log2(1 - q0) ELSE 0 END) AS e0,
  -(CASE WHEN q1 > 0 THEN q1 * log2(q1) ELSE 0 END + CASE WHEN q1 < 1 THEN (1 - q1) * log2(1 - q1) ELSE 0 END) AS e1,
  -(CASE WHEN q2 > 0 THEN q2 * log2(q2) ELSE 0 END + CASE WHEN q2 < 1 THEN (1 - q2) * log2(1 - q2) ELSE 0 END) AS e2 FROM q)
SELECT 'n_chars' AS feature, x AS threshold, round(e0 - nl / n * e1 - nr / n * e2, 6) AS gain FROM e ORDER BY round(e0 - nl / n * e1 - nr / n * e2, 12) DESC, x LIMIT 1
""")
def tree_best_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return ml.best_split(rows, ["n_chars"], "quality").withColumn("gain", F.round("gain", 6))


_GROWN = "r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, CAST(l_suppkey % 3 AS DOUBLE) AS y, l_extendedprice AS z FROM lineitem)"
_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _grown(depth: int, label: str, regression: bool) -> str:
    """SQL of a tree, level by level: table ``n`` of each row's leaf, ``leaf`` of the leaves' values."""
    stats = "sum(y) AS a, sum(y * y) AS b, 0 AS c" if regression else "count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b, count(*) FILTER (y = 2) AS c"

    def impurity(n: str, a: str, b: str, c: str) -> str:
        if regression:
            return f"({b} / {n} - ({a} / {n}) * ({a} / {n}))"
        return "-(" + " + ".join(f"CASE WHEN {x} > 0 THEN {x} / {n} * log2({x} / {n}) ELSE 0 END" for x in (a, b, c)) + ")"

    out = [_GROWN, f"n0 AS (SELECT 1 AS node, l_orderkey, l_linenumber, l_quantity AS f0, l_discount AS f1, l_tax AS f2, {label} AS y FROM r)"]
    for i in range(1, depth + 1):
        out.append(f"v{i} AS (SELECT node, f, x, count(*)::DOUBLE AS n, {stats} FROM (SELECT node, y, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS x FROM n{i - 1}) GROUP BY ALL)")
        sums = ", ".join(f"sum({c})::DOUBLE OVER w AS l{c}, sum({c})::DOUBLE OVER (PARTITION BY node, f) AS t{c}" for c in "nabc").replace("::DOUBLE OVER w", " OVER w").replace("::DOUBLE OVER (", " OVER (")
        out.append(f"s{i} AS (SELECT node, f, x, {sums} FROM v{i} WINDOW w AS (PARTITION BY node, f ORDER BY x))")
        gain = f"{impurity('tn', 'ta', 'tb', 'tc')} - ln / tn * {impurity('ln', 'la', 'lb', 'lc')} - (tn - ln) / tn * {impurity('(tn - ln)', '(ta - la)', '(tb - lb)', '(tc - lc)')}"
        out.append(f"g{i} AS (SELECT node, f, x, round({gain}, 12) AS gain FROM s{i} WHERE ln < tn)")
        out.append(f"b{i} AS (SELECT node, f, x, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, x) AS k FROM g{i}) WHERE k = 1 AND gain > 0)")
        out.append(f"n{i} AS (SELECT CASE WHEN b.node IS NULL THEN a.node WHEN [f0, f1, f2][b.f + 1] <= b.x THEN 2 * a.node ELSE 2 * a.node + 1 END AS node, l_orderkey, l_linenumber, f0, f1, f2, y FROM n{i - 1} a LEFT JOIN b{i} b ON a.node = b.node)")
    if regression:
        out.append(f"leaf AS (SELECT node, avg(y) AS value FROM n{depth} GROUP BY node)")
    else:
        out.append(f"leaf AS (SELECT node, y AS value FROM (SELECT node, y, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, y) AS k FROM n{depth} GROUP BY node, y) WHERE k = 1)")
    return ",\n".join(out)


def _leaves(depth: int) -> str:
    return f"SELECT l_orderkey, l_linenumber, round(value, 4) AS value FROM n{depth} JOIN leaf ON n{depth}.node = leaf.node"


def _tree_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("y", (F.col("l_suppkey") % 3).cast("double")).withColumn("z", F.col("l_extendedprice"))


@query(f"WITH {_grown(1, 'y', False)} SELECT ['l_quantity', 'l_discount', 'l_tax'][f + 1] AS feature, x AS threshold, round(gain, 6) AS gain FROM b1")
def tree_split_classes(spark: SparkSession, d: str) -> DataFrame:
    """The best first split over three classes."""
    return ml.best_split(_tree_rows(spark, d), _FEATURES, "y", [0.0, 1.0, 2.0]).withColumn("gain", F.round("gain", 6))


@query(f"WITH {_grown(1, 'z', True)} SELECT ['l_quantity', 'l_discount', 'l_tax'][f + 1] AS feature, x AS threshold, round(gain, 0) AS gain FROM b1")
def tree_split_squares(spark: SparkSession, d: str) -> DataFrame:
    """The best first split of numbers, by squared error."""
    return ml.best_split(_tree_rows(spark, d), _FEATURES, "z", None).withColumn("gain", F.round("gain", 0))


@query(f"WITH {_grown(2, 'y', False)} {_leaves(2)}")
def tree_classes(spark: SparkSession, d: str) -> DataFrame:
    """A tree of two levels over three classes, and what it predicts for every row."""
    rows = _tree_rows(spark, d)
    tree = learners.grow_tree(rows, _FEATURES, "y", depth=2)
    return rows.select("l_orderkey", "l_linenumber", F.round(tree.predicted(), 4).alias("value"))


@query(f"WITH {_grown(2, 'z', True)} {_leaves(2)}")
def tree_regression(spark: SparkSession, d: str) -> DataFrame:
    """A tree of two levels with means in its leaves."""
    rows = _tree_rows(spark, d)
    tree = learners.grow_tree(rows, _FEATURES, "z", depth=2, regression=True)
    return rows.select("l_orderkey", "l_linenumber", F.round(tree.predicted(), 4).alias("value"))


def _descended(steps: int, rate: float, slope: str, cost: str, decay: float = 0.0) -> str:
    """SQL of gradient descent on two features, a table for each step."""
    out = ["r AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, CASE WHEN l_extendedprice > 40000 THEN 1.0 ELSE -1.0 END AS y FROM lineitem)", "w0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS w, 0.0::DOUBLE AS loss)"]
    for i in range(steps):
        out.append(f"e{i} AS (SELECT r.*, wa, wb, w, wa * a + wb * b + w AS p FROM r, w{i})")
        out.append(f"w{i + 1} AS (SELECT any_value(wa) - {rate} * (avg({slope} * a) + {decay} * any_value(wa)) AS wa, any_value(wb) - {rate} * (avg({slope} * b) + {decay} * any_value(wb)) AS wb, any_value(w) - {rate} * avg({slope}) AS w, avg({cost}) AS loss FROM e{i})")
    rows = " UNION ALL ".join(f"SELECT 'loss{i}' AS name, loss AS value FROM w{i + 1}" for i in range(steps))
    return "WITH " + ",\n".join(out) + f" SELECT name, round(value, 6) AS value FROM ({rows} UNION ALL SELECT unnest(['a', 'b', 'bias']), unnest([wa, wb, w]) FROM w{steps})"


def _fitted(spark: SparkSession, d: str, **how) -> DataFrame:
    y = F.when(F.col("l_extendedprice") > 40000, 1.0).otherwise(-1.0)
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), y.alias("y"))
    (wa, wb), w, losses = ml.fit_linear(rows, ["a", "b"], "y", 4, 0.3, **how)
    found = [(f"loss{i}", x) for i, x in enumerate(losses)] + [("a", wa), ("b", wb), ("bias", w)]
    return spark.createDataFrame(found, "name string, value double").withColumn("value", F.round("value", 6))


@query(_descended(4, 0.3, "(2 * (p - y))", "(p - y) * (p - y)"))
def regression_loop(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d)


@query(_descended(4, 0.3, "(CASE WHEN y * p < 1 THEN -y ELSE 0 END)", "greatest(1 - y * p, 0)", 0.01))
def svm_binary(spark: SparkSession, d: str) -> DataFrame:
    """A linear support vector machine by the hinge loss."""
    return _fitted(spark, d, loss="hinge", decay=0.01)


@query(_descended(4, 0.3, "(CASE WHEN abs(p - y) > 0.1 THEN sign(p - y) ELSE 0 END)", "greatest(abs(p - y) - 0.1, 0)", 0.01))
def svm_regression(spark: SparkSession, d: str) -> DataFrame:
    """Linear support vector regression by the insensitive loss."""
    return _fitted(spark, d, loss="insensitive", margin=0.1, decay=0.01)


#: Two columns of every row, and a class that no straight line tells: the middle quantities.
_BAND = "r AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, CASE WHEN l_quantity BETWEEN 15 AND 35 THEN 1.0 ELSE -1.0 END AS y FROM lineitem)"
_SIZE, _GAMMA, _SEED = 8, 2.0, 7


def _drawn(*index: object) -> str:
    return f"((('0x' || substr(md5('{':'.join(map(str, (_SEED, *index)))}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _fourier() -> list[str]:
    """SQL of the features: a hashed normal frequency for each column, and a hashed phase."""
    normal = lambda i, j: f"(sqrt(-2 * ln({_drawn(i, j, 'a')})) * cos(2 * pi() * {_drawn(i, j, 'b')}) * sqrt(2 * {_GAMMA}))"
    return [f"cos(a * {normal(0, j)} + b * {normal(1, j)} + 2 * pi() * {_drawn(j)}) * sqrt(2.0 / {_SIZE})" for j in range(_SIZE)]


def _descended_on(features: list[str], slope: str, cost: str, steps: int = 3, rate: float = 0.5, decay: float = 0.01) -> str:
    """SQL of gradient descent on any features of _BAND's rows, a table for each step, and the share of right signs."""
    n = range(len(features))
    out = [_BAND, "z AS (SELECT y, " + ", ".join(f"{f} AS z{j}" for j, f in enumerate(features)) + " FROM r)", "w0 AS (SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS loss, " + ", ".join(f"0.0::DOUBLE AS w{j}" for j in n) + ")"]
    for i in range(steps + 1):
        out.append(f"e{i} AS (SELECT z.*, w{i}.*, " + " + ".join(f"w{j} * z{j}" for j in n) + f" + w AS p FROM z, w{i})")
        moved = ", ".join(f"any_value(w{j}) - {rate} * (avg({slope} * z{j}) + {decay} * any_value(w{j})) AS w{j}" for j in n)
        if i < steps:
            out.append(f"w{i + 1} AS (SELECT any_value(w) - {rate} * avg({slope}) AS w, avg({cost}) AS loss, {moved} FROM e{i})")
    rows = [f"SELECT 'loss{i}' AS name, loss AS value FROM w{i + 1}" for i in range(steps)] + [f"SELECT 'w{j}', w{j} FROM w{steps}" for j in n]
    rows += [f"SELECT 'bias', w FROM w{steps}", f"SELECT 'right', avg(CASE WHEN p * y > 0 THEN 1.0 ELSE 0.0 END) FROM e{steps}"]
    return "WITH " + ",\n".join(out) + f" SELECT name, round(value, 6) AS value FROM ({' UNION ALL '.join(rows)})"


def _fitted_on(spark: SparkSession, d: str, features: list[Column], **how) -> DataFrame:
    y = F.when(F.col("l_quantity").between(15, 35), 1.0).otherwise(-1.0)
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), y.alias("y"))
    names = [f"z{j}" for j in range(len(features))]
    rows = rows.select("y", *(f.alias(n) for f, n in zip(features, names, strict=True)))
    w, b, losses = ml.fit_linear(rows, names, "y", 3, 0.5, decay=0.01, **how)
    right = F.avg(F.when(ml.predicted([F.col(n) for n in names], w, b) * F.col("y") > 0, 1.0).otherwise(0.0)).alias("value")
    found = [(f"loss{i}", x) for i, x in enumerate(losses)] + list(zip([f"w{j}" for j in range(len(w))], w, strict=True)) + [("bias", b)]
    fitted = spark.createDataFrame(found, "name string, value double")
    return fitted.unionByName(rows.agg(right).select(F.lit("right").alias("name"), "value")).withColumn("value", F.round("value", 6))


_HINGE = ("(CASE WHEN y * p < 1 THEN -y ELSE 0 END)", "greatest(1 - y * p, 0)")
_INSENSITIVE = ("(CASE WHEN abs(p - y) > 0.1 THEN sign(p - y) ELSE 0 END)", "greatest(abs(p - y) - 0.1, 0)")


@query(_descended_on(_fourier(), *_HINGE))
def svm_rbf(spark: SparkSession, d: str) -> DataFrame:
    """A support vector machine with a Gaussian kernel, by hashed Fourier features."""
    return _fitted_on(spark, d, learners.fourier_features([F.col("a"), F.col("b")], _SIZE, _GAMMA, _SEED), loss="hinge")


@query(_descended_on(_fourier(), *_INSENSITIVE))
def svr_rbf(spark: SparkSession, d: str) -> DataFrame:
    """Support vector regression with a Gaussian kernel."""
    return _fitted_on(spark, d, learners.fourier_features([F.col("a"), F.col("b")], _SIZE, _GAMMA, _SEED), loss="insensitive", margin=0.1)


@query(_descended_on(["a", "b", "a * a", "a * b", "b * b"], *_HINGE))
def svm_polynomial(spark: SparkSession, d: str) -> DataFrame:
    """A support vector machine with a polynomial kernel of degree 2: a linear one on its monomials."""
    return _fitted_on(spark, d, [c for _, c in ml.polynomial(["a", "b"], 2)], loss="hinge")


_STEPPED = {
    "sgd": ("v - 0.1 * g", "m", "s"),
    "momentum": ("v + (0.9 * m - 0.1 * g)", "0.9 * m - 0.1 * g", "s"),
    "adagrad": ("v - 0.1 * g / sqrt(s + g * g + 1e-8)", "m", "s + g * g"),
    "adam": ("v - 0.1 * ((0.9 * m + 0.1 * g) / (1 - pow(0.9, {t}))) / (sqrt((0.999 * s + 0.001 * g * g) / (1 - pow(0.999, {t}))) + 1e-8)", "0.9 * m + 0.1 * g", "0.999 * s + 0.001 * g * g"),
}


def _optimised_sql() -> str:
    parts, out = [], ["o0 AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings)"]
    for rule, (v, m, s) in _STEPPED.items():
        out.append(f"{rule}0 AS (SELECT i, j, v, 2 * v AS g, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM o0)")
        out += [f"{rule}{t} AS (SELECT i, j, nv AS v, 2 * nv AS g, nm AS m, ns AS s FROM (SELECT i, j, {v.format(t=t)} AS nv, {m} AS nm, {s} AS ns FROM {rule}{t - 1}))" for t in (1, 2, 3)]
        parts.append(f"SELECT '{rule}' AS rule, i, CAST(j AS INTEGER) AS j, round(v, 6) + 0.0 AS v FROM {rule}3")
    return "WITH " + ",\n".join(out) + " " + " UNION ALL ".join(parts)


@query(_optimised_sql())
def optimizer_steps(spark: SparkSession, d: str) -> DataFrame:
    """Three steps of every rule on a whole matrix of parameters; the gradient is that of the sum of squares."""
    start = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))
    found = []
    for rule in _STEPPED:
        held = start.withColumns({"g": 2 * F.col("v"), "m": F.lit(0.0), "s": F.lit(0.0)})
        for step in (1, 2, 3):
            held = learners.optimised(held, rule, step, rate=0.1).withColumn("g", 2 * F.col("v"))
        found.append(held.select(F.lit(rule).alias("rule"), "i", "j", (F.round("v", 6) + 0.0).alias("v")))  # no negative zero
    return reduce(DataFrame.unionByName, found)


_U = "((('0x' || substr(md5('3:' || p_partkey || ':' || p_size || '{x}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
_N = f"(sqrt(-2 * ln({_U.format(x=':a')})) * cos(2 * pi() * {_U.format(x=':b')}))"


@query(f"SELECT p_partkey, round({_U.format(x='')} * 2 - 1, 6) AS uniform, round(({_U.format(x='')} * 2 - 1) * sqrt(6.0 / 12), 6) AS xavier_uniform, round({_N} * sqrt(2.0 / 12), 6) AS xavier_normal, round({_N} * sqrt(2.0 / 8), 6) AS he, round({_N}, 6) AS randn FROM part")
def initial_weights(spark: SparkSession, d: str) -> DataFrame:
    """Random weights of cells named by part and size; they depend on seed and cell alone."""
    i, j = F.col("p_partkey"), F.col("p_size")
    rules = {r: learners.initialised(i, j, r, 8, 4, 3) for r in ("uniform", "xavier_uniform", "xavier_normal", "he")} | {"randn": learners.random_normal(3, i, j)}
    return table(spark, d, "part").select("p_partkey", *(F.round(c, 6).alias(n) for n, c in rules.items()))


_PREDICTED = "r AS (SELECT o_orderkey, o_totalprice AS y, 0.9 * o_totalprice + 100.0 AS p FROM orders)"


@query(f"WITH {_PREDICTED} SELECT o_orderkey, round(p, 6) AS p FROM r")
def linreg_predict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(ml.predicted([F.col("o_totalprice")], [0.9], 100.0), 6).alias("p"))


@query(f"WITH {_PREDICTED} SELECT round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(avg((p - y) * (p - y)), 2) AS mse, round(avg(abs(p - y)), 4) AS mae FROM r")
def metrics_r2_mse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_totalprice").alias("y"), ml.predicted([F.col("o_totalprice")], [0.9], 100.0).alias("p"))
    return ml.r2(rows, "y", "p").select(F.round("r2", 6).alias("r2"), F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"))


@query("SELECT round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels")
def metrics_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.round(ml.accuracy(F.col("quality"), 1 - F.col("toxic")), 6).alias("accuracy"))


@query("""
WITH r AS (SELECT CAST(l_quantity > 25 AS INTEGER) * 1.0 AS y, l_quantity / 50 AS p FROM lineitem), q AS (SELECT y, p, p - y AS e, least(greatest(p, 1e-15), 1 - 1e-15) AS c FROM r)
SELECT round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS mae, round(-avg(y * ln(c) + (1 - y) * ln(1 - c)), 6) AS bce,
  round(avg(CASE WHEN abs(e) <= 0.5 THEN 0.5 * e * e ELSE 0.5 * (abs(e) - 0.25) END), 6) AS huber FROM q
""")
def losses_all(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("double").alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return rows.agg(*(F.round(c, 6).alias(n) for n, c in ml.losses(F.col("y"), F.col("p"), 0.5).items()))


@query("""
WITH r AS (SELECT DISTINCT (l_quantity - 25) / 10 AS x FROM lineitem)
SELECT round(x, 6) AS x, round(greatest(x, 0), 6) AS relu, round(CASE WHEN x > 0 THEN x ELSE 0.01 * x END, 6) AS leaky_relu, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS elu,
  round(1 / (1 + exp(-x)), 6) AS sigmoid, round((exp(2 * x) - 1) / (exp(2 * x) + 1), 6) AS tanh, round(x, 6) AS linear FROM r
""")
def activations_all(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(((F.col("l_quantity") - 25) / 10).alias("x")).distinct()
    return x.select(F.round("x", 6).alias("x"), *(F.round(c, 6).alias(n) for n, c in ml.activations(F.col("x")).items()))


@query("""
WITH p AS (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings),
e AS (SELECT vec_id, j, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM p)
SELECT vec_id, CAST(j AS INTEGER) AS pos, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e
""")
def softmax_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(ml.softmax(F.col("embedding"))).alias("pos", "p"))
    return rows.withColumn("p", F.round("p", 6))


_M = "m AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings)"


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return ml.coo(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"WITH {_M} SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(sum(a.v * b.v), 5) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")
def matmul_coo(spark: SparkSession, d: str) -> DataFrame:
    """The transposed matrix times the matrix."""
    m = _matrix(spark, d)
    return ml.matmul(ml.transposed(m), m).withColumn("v", F.round("v", 5))


@query(f"WITH {_M} SELECT i, round(sum(v), 6) AS sum, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM m GROUP BY i")
def matrix_reductions(spark: SparkSession, d: str) -> DataFrame:
    r = ml.reduced(_matrix(spark, d), "i")
    return r.select("i", *(F.round(c, 6).alias(c) for c in ("sum", "min", "max", "mean", "std")))


@query(f"WITH {_M} SELECT CAST(floor((i * 64 + j) / 32) AS BIGINT) AS i, CAST((i * 64 + j) % 32 AS BIGINT) AS j, round(v, 6) AS v FROM m")
def matrix_reshape(spark: SparkSession, d: str) -> DataFrame:
    return ml.reshaped(_matrix(spark, d), 64, 32).withColumn("v", F.round("v", 6))


@query(f"""
WITH {_M}, c AS (SELECT i, max(v) AS c FROM m GROUP BY i), r AS (SELECT j, avg(v) AS r FROM m GROUP BY j), t AS (SELECT max(v) AS t FROM m)
SELECT m.i, CAST(m.j AS BIGINT) AS j, round(v * v, 6) AS square, round(v + c, 6) AS plus_column, round(v - r, 6) AS minus_row, round(v / t, 6) AS by_scalar
FROM m JOIN c ON m.i = c.i JOIN r ON m.j = r.j, t
""")
def matrix_elementwise(spark: SparkSession, d: str) -> DataFrame:
    """A matrix with itself, with a column, a row and a scalar."""
    m = _matrix(spark, d)
    column, row = ml.reduced(m, "i").select("i", F.col("max").alias("v")), ml.reduced(m, "j").select("j", F.col("mean").alias("v"))
    found = {"square": (m, "*", ("i", "j")), "plus_column": (column, "+", ("i",)), "minus_row": (row, "-", ("j",)), "by_scalar": (m.agg(F.max("v").alias("v")), "/", ())}
    parts = [ml.elementwise(m, b, op, over).select("i", "j", F.round("v", 6).alias(n)) for n, (b, op, over) in found.items()]
    return reduce(lambda a, b: a.join(b, ["i", "j"]), parts)


@query(f"WITH {_M} SELECT i, CAST(j AS BIGINT) AS j, round(sqrt(abs(v)), 6) AS root, round(exp(v), 6) AS exp, round(ln(exp(v)), 6) AS log FROM m")
def matrix_functions(spark: SparkSession, d: str) -> DataFrame:
    m = _matrix(spark, d)
    parts = {"root": ml.mapped(ml.mapped(m, "abs"), "sqrt"), "exp": ml.mapped(m, "exp"), "log": ml.mapped(ml.mapped(m, "exp"), "log")}
    return reduce(lambda a, b: a.join(b, ["i", "j"]), (p.select("i", "j", F.round("v", 6).alias(n)) for n, p in parts.items()))


@query("""
WITH n AS (SELECT count(*) AS n FROM nation), c AS (SELECT i, unnest(range(7)) AS j FROM (SELECT unnest(range(n)) AS i FROM n))
SELECT 'zeros' AS kind, i, j, 0.0::DOUBLE AS v FROM c UNION ALL SELECT 'ones', i, j, 1.0 FROM c UNION ALL SELECT 'identity', i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM c
""")
def matrix_filled(spark: SparkSession, d: str) -> DataFrame:
    """Matrices of a row for each nation."""
    n = table(spark, d, "nation").count()
    kinds = {"zeros": 0.0, "ones": 1.0, "identity": (F.col("i") == F.col("j")).cast("double")}
    return reduce(DataFrame.unionByName, (ml.filled(spark, n, 7, v).select(F.lit(k).alias("kind"), "i", "j", "v") for k, v in kinds.items()))


@query("SELECT p_partkey, round(CAST(p_size AS DOUBLE), 4) AS s, round(p_retailprice, 4) AS r, round(CAST(p_size * p_size AS DOUBLE), 4) AS s_s, round(p_size * p_retailprice, 4) AS s_r, round(p_retailprice * p_retailprice, 4) AS r_r FROM part")
def polynomial_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    return rows.select("p_partkey", *(F.round(c, 4).alias(n) for n, c in ml.polynomial(["s", "r"], 2)))


@query("""
WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag),
r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS k FROM v)
SELECT l_orderkey, l_returnflag FROM r WHERE k = 1
""")
def forest_vote(spark: SparkSession, d: str) -> DataFrame:
    return ml.majority(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


_BY_LENGTH = "r AS (SELECT d.doc_id AS l_orderkey, 0 AS l_linenumber, n_chars AS l_quantity, 0 AS l_discount, 0 AS l_tax, CAST(quality AS DOUBLE) AS y, 0 AS z FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"WITH {_grown(2, 'y', False).replace(_GROWN, _BY_LENGTH)} SELECT l_orderkey AS doc_id, value AS quality FROM n2 JOIN leaf ON n2.node = leaf.node")
def tree_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", learners.grow_tree(rows, ["n_chars"], "quality", depth=2).predicted().alias("quality"))


_TREES, _DEPTH, _DRAWN = 4, 2, 2


def _forest(label: str, regression: bool) -> str:
    """SQL of a forest: bootstraps, levels of all trees, leaves; then every row through every tree (tables ``q``)."""
    size = 1 << (_DEPTH + 1)
    uniform = lambda *parts: "((('0x' || substr(md5(concat_ws(':', '7', " + ", ".join(parts) + ")), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
    chance = uniform("tree", "l_orderkey", "l_linenumber")
    times = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in learners.DRAWN)
    stats = "sum(w * y) AS a, sum(w * y * y) AS b, 0 AS c" if regression else "sum(w) FILTER (y = 0) AS a, sum(w) FILTER (y = 1) AS b, sum(w) FILTER (y = 2) AS c"

    def impurity(n: str, a: str, b: str, c: str) -> str:
        if regression:
            return f"({b} / {n} - ({a} / {n}) * ({a} / {n}))"
        return "-(" + " + ".join(f"CASE WHEN {x} > 0 THEN {x} / {n} * log2({x} / {n}) ELSE 0 END" for x in (a, b, c)) + ")"

    def moved(before: str, level: int, more: str) -> str:
        below = f"a.node + a.node % {size} + CASE WHEN [f0, f1, f2][b.f + 1] <= b.x THEN 0 ELSE 1 END"
        return f"(SELECT CASE WHEN b.node IS NULL THEN a.node ELSE {below} END AS node, {more} FROM {before} a LEFT JOIN b{level} b ON a.node = b.node)"

    out = [_GROWN, f"t AS (SELECT r.*, tree, tree * {size} + 1 AS node, l_quantity AS f0, l_discount AS f1, l_tax AS f2, {chance} AS u FROM r, (SELECT unnest(range({_TREES})) AS tree))"]
    out.append(f"n0 AS (SELECT node, f0, f1, f2, {label} AS y, {times} AS w FROM t WHERE {times} > 0)")
    for i in range(1, _DEPTH + 1):
        out.append(f"v{i} AS (SELECT node, f, x, sum(w)::DOUBLE AS n, {stats} FROM (SELECT node, y, w, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS x FROM n{i - 1}) GROUP BY node, f, x)")
        out.append(f"d{i} AS (SELECT node, f FROM (SELECT node, f, row_number() OVER (PARTITION BY node ORDER BY {uniform('node', 'f')}) AS k FROM (SELECT DISTINCT node, unnest([0, 1, 2]) AS f FROM n{i - 1})) WHERE k <= {_DRAWN})")
        sums = ", ".join(f"sum(coalesce({c}, 0)) OVER w AS l{c}, sum(coalesce({c}, 0)) OVER (PARTITION BY node, f) AS t{c}" for c in "nabc")
        out.append(f"s{i} AS (SELECT node, f, x, {sums} FROM v{i} JOIN d{i} USING (node, f) WINDOW w AS (PARTITION BY node, f ORDER BY x))")
        gain = f"{impurity('tn', 'ta', 'tb', 'tc')} - ln / tn * {impurity('ln', 'la', 'lb', 'lc')} - (tn - ln) / tn * {impurity('(tn - ln)', '(ta - la)', '(tb - lb)', '(tc - lc)')}"
        out.append(f"g{i} AS (SELECT node, f, x, round({gain}, 12) AS gain FROM s{i} WHERE ln < tn)")
        out.append(f"b{i} AS (SELECT node, f, x FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, x) AS k FROM g{i}) WHERE k = 1 AND gain > 0)")
        out.append(f"n{i} AS {moved(f'n{i - 1}', i, 'f0, f1, f2, y, w')}")
    if regression:
        out.append(f"leaf AS (SELECT node, sum(w * y) / sum(w) AS value FROM n{_DEPTH} GROUP BY node)")
    else:
        out.append(f"leaf AS (SELECT node, y AS value FROM (SELECT node, y, row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, y) AS k FROM n{_DEPTH} GROUP BY node, y) WHERE k = 1)")
    out.append("q0 AS (SELECT node, tree, l_orderkey, l_linenumber, f0, f1, f2 FROM t)")
    out += [f"q{i} AS {moved(f'q{i - 1}', i, 'tree, l_orderkey, l_linenumber, f0, f1, f2')}" for i in range(1, _DEPTH + 1)]
    out.append(f"said AS (SELECT l_orderkey, l_linenumber, value FROM q{_DEPTH} q JOIN leaf ON q.node = leaf.node)")
    return ",\n".join(out)


def _forest_of(spark: SparkSession, d: str, label: str, regression: bool) -> DataFrame:
    rows, keys = _tree_rows(spark, d), ["l_orderkey", "l_linenumber"]
    grown = learners.grow_forest(rows, keys, _FEATURES, label, _TREES, _DEPTH, _DRAWN, seed=7, regression=regression)
    return learners.forest_values(rows, keys, _FEATURES, grown)


@query(f"""
WITH {_forest("y", False)},
v AS (SELECT l_orderkey, l_linenumber, value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY count(*) DESC, value) AS k FROM said GROUP BY l_orderkey, l_linenumber, value)
SELECT l_orderkey, l_linenumber, value FROM v WHERE k = 1
""")
def forest_predict(spark: SparkSession, d: str) -> DataFrame:
    """Trees on bootstraps with drawn features, and the vote of all of them on every row."""
    said = _forest_of(spark, d, "y", False)
    counts = said.groupBy("l_orderkey", "l_linenumber", "value").count()
    return counts.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("value", F.struct(-F.col("count"), "value")).alias("value"))


@query(f"WITH {_forest('z', True)} SELECT l_orderkey, l_linenumber, round(avg(value), 4) AS value FROM said GROUP BY l_orderkey, l_linenumber")
def forest_regression(spark: SparkSession, d: str) -> DataFrame:
    """The same for numbers: means in the leaves, and the mean of all trees."""
    return _forest_of(spark, d, "z", True).groupBy("l_orderkey", "l_linenumber").agg(F.round(F.avg("value"), 4).alias("value"))


_LABELS = 10


def _trained(sizes: list[int], loss: str, epochs: int, rate: float, momentum: float = 0.0, decay: float = 0.0, seed: int | None = None) -> str:
    """SQL of a network on ``embeddings``: tanh between layers, then softmax (``categorical``) or nothing (``hinge``).

    Tables ``w{layer}_{epoch}`` (i, j, v, m), ``o{epoch}`` (outputs) and ``c{epoch}`` (losses); rows of all layers are
    numbered one after the other, a layer's biases last.
    """
    layers, starts = range(len(sizes) - 1), [sum(n + 1 for n in sizes[:k]) for k in range(len(sizes))]
    label = "JOIN embeddings USING (vec_id)"
    out = [f"a0 AS MATERIALIZED (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings UNION ALL SELECT vec_id, {sizes[0]}, 1 FROM embeddings)"]
    for k in layers:
        drawn = "0.0" if seed is None else f"(((('0x' || substr(md5('{seed}:' || i || ':' || j), 1, 8))::BIGINT + 0.5) / 4294967296.0) * 2 - 1) * sqrt(6.0 / {sizes[k] + sizes[k + 1]})"
        bias = starts[k] + sizes[k]
        out.append(f"w{k}_0 AS MATERIALIZED (SELECT i, j, CASE WHEN i = {bias} THEN 0.0 ELSE {drawn} END::DOUBLE AS v, 0.0::DOUBLE AS m FROM range({starts[k]}, {bias + 1}) a(i), range({sizes[k + 1]}) b(j))")
    for e in range(epochs + 1):
        came = "a0"
        for k in layers:
            z = f"SELECT vec_id, w.j, sum(x.v * w.v) AS z FROM {came} x JOIN w{k}_{e} w ON x.i = w.i GROUP BY vec_id, w.j"
            if k < layers[-1]:
                end = f"SELECT DISTINCT vec_id, {starts[k + 1] + sizes[k + 1]}, 1.0 FROM embeddings"
                came = f"h{k}_{e}"
                out.append(f"{came} AS MATERIALIZED (SELECT vec_id, j + {starts[k + 1]} AS i, (exp(2 * z) - 1) / (exp(2 * z) + 1) AS v FROM ({z}) UNION ALL {end})")
            elif loss == "categorical":
                out.append(f"o{e} AS MATERIALIZED (SELECT vec_id, j, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, j, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM ({z})))")
                out.append(f"c{e} AS (SELECT avg(-ln(p)) AS loss FROM o{e} {label} WHERE j = label)")
                slope = "p - CASE WHEN j = label THEN 1 ELSE 0 END"
            else:
                sign = "CASE WHEN j = label THEN 1 ELSE -1 END"
                out.append(f"o{e} AS MATERIALIZED (SELECT vec_id, j, z AS p FROM ({z}))")
                out.append(f"c{e} AS (SELECT sum(greatest(1 - p * ({sign}), 0)) / count(DISTINCT vec_id) AS loss FROM o{e} {label})")
                slope = f"CASE WHEN p * ({sign}) < 1 THEN -({sign}) ELSE 0 END"
        if e == epochs:
            break
        after = f"(SELECT vec_id, j, {slope} AS d FROM o{e} {label})"
        for k in reversed(layers):
            came = f"h{k - 1}_{e}" if k else "a0"
            out.append(f"d{k}_{e} AS MATERIALIZED (SELECT * FROM {after})")
            out.append(f"g{k}_{e} AS MATERIALIZED (SELECT x.i, d.j, sum(x.v * d.d) / (SELECT count(*) FROM embeddings) AS g FROM {came} x JOIN d{k}_{e} d USING (vec_id) GROUP BY x.i, d.j)")
            shrunk = f"{rate} * (g + CASE WHEN w.i = {starts[k] + sizes[k]} THEN 0 ELSE {decay} * v END)"
            out.append(f"w{k}_{e + 1} AS MATERIALIZED (SELECT w.i, w.j, v + {momentum} * m - {shrunk} AS v, {momentum} * m - {shrunk} AS m FROM w{k}_{e} w JOIN g{k}_{e} g ON w.i = g.i AND w.j = g.j)")
            after = f"(SELECT x.vec_id, x.i - {starts[k]} AS j, any_value(1 - x.v * x.v) * sum(d.d * w.v) AS d FROM {came} x JOIN d{k}_{e} d ON x.vec_id = d.vec_id JOIN w{k}_{e} w ON w.i = x.i AND w.j = d.j WHERE x.i < {starts[k] + sizes[k]} GROUP BY x.vec_id, x.i)"
    return "WITH " + ",\n".join(out)


def _fitted_network(layers: int, epochs: int) -> str:
    weights = " UNION ALL ".join(f"SELECT 'weight' AS kind, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM w{k}_{epochs}" for k in range(layers))
    costs = " UNION ALL ".join(f"SELECT 'loss', {e}, 0, loss FROM c{e}" for e in range(epochs))
    return f"SELECT kind, i, j, round(v, 6) + 0.0 AS v FROM ({weights} UNION ALL {costs})"


def _best_output(epochs: int) -> str:
    return f"SELECT vec_id, CAST(j AS INTEGER) AS prediction FROM (SELECT vec_id, j, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, j) AS k FROM o{epochs}) WHERE k = 1"


def _fit_vectors(spark: SparkSession, d: str, off: float, **how) -> networks.Network:
    rows = table(spark, d, "embeddings").select("embedding", networks.one_of(F.col("label"), _LABELS, off).alias("t"))
    return networks.train(rows, "embedding", "t", **how)


def _network_rows(spark: SparkSession, network: networks.Network) -> DataFrame:
    cells = [("weight", i, j, v) for i, j, v in networks.cells(network.weights)] + [("loss", e, 0, c) for e, c in enumerate(network.losses)]
    return spark.createDataFrame(cells, "kind string, i long, j long, v double").withColumn("v", F.round("v", 6) + 0.0)


def _said(spark: SparkSession, d: str, network: networks.Network) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", networks.largest(networks.scores(F.col("embedding"), network)).alias("prediction"))


_MACHINE = {"sizes": [64, _LABELS], "activations": ["linear"], "loss": "hinge", "epochs": 6, "rate": 0.3, "decay": 0.01, "initial": None}
_NETWORK = {"sizes": [64, 6, _LABELS], "activations": ["tanh", "softmax"], "loss": "categorical", "epochs": 6, "rule": "momentum", "rate": 0.5, "seed": 7}
_MACHINE_SQL = _trained([64, _LABELS], "hinge", 6, 0.3, decay=0.01)
_NETWORK_SQL = _trained([64, 6, _LABELS], "categorical", 6, 0.5, 0.9, seed=7)


@query(f"{_MACHINE_SQL} {_best_output(6)}")
def svm_multiclass(spark: SparkSession, d: str) -> DataFrame:
    """One support vector machine against the rest for each class, all of them in one pass a step; the largest margin wins."""
    return _said(spark, d, _fit_vectors(spark, d, -1.0, **_MACHINE))


@query(f"{_MACHINE_SQL} {_fitted_network(1, 6)}")
def svm_multiclass_fit(spark: SparkSession, d: str) -> DataFrame:
    """Weights, biases and losses of these machines."""
    return _network_rows(spark, _fit_vectors(spark, d, -1.0, **_MACHINE))


@query(f"{_NETWORK_SQL} {_fitted_network(2, 6)}")
def network_fit(spark: SparkSession, d: str) -> DataFrame:
    """Six epochs of a network with one hidden layer, by momentum: every weight and the losses."""
    return _network_rows(spark, _fit_vectors(spark, d, 0.0, **_NETWORK))


@query(f"{_NETWORK_SQL} {_best_output(6)}")
def network_predict(spark: SparkSession, d: str) -> DataFrame:
    """The most probable class by that network."""
    return _said(spark, d, _fit_vectors(spark, d, 0.0, **_NETWORK))


@query("""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(greatest(e[1] + 2 * e[2] + 0.5, 0), 6) AS a, round(greatest(e[64] - e[1] - 0.1, 0), 6) AS b FROM p
""")
def dense_forward(spark: SparkSession, d: str) -> DataFrame:
    weights = [[1.0, 2.0] + [0.0] * 62, [-1.0] + [0.0] * 62 + [1.0]]
    out = learners.dense(F.col("embedding"), weights, [0.5, -0.1], lambda x: F.greatest(x, F.lit(0.0)))
    return table(spark, d, "embeddings").select("vec_id", out.alias("o")).select("vec_id", F.round(F.get("o", F.lit(0)), 6).alias("a"), F.round(F.get("o", F.lit(1)), 6).alias("b"))
