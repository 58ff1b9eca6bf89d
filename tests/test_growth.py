"""What queries cost as their tables grow: how often a thing is asked, and over how many tasks rows are dealt."""

import hashlib
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import arrays, code_graph, embedding, ml, question_search, vector_search
from lodestone.operators.chunk_store import ChunkStore
from lodestone.plans import array_queries, fixtures, lineage


def test_a_split_asks_once_which_features_a_node_may_use(spark):
    """Not for every row or value of a feature (forests)."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def drawn(node, feature):
        asked.add(1)
        return feature == node % 2

    rows = spark.range(4000).select((F.col("id") % 4).alias("node"), F.col("id").cast("double").alias("a"), (F.col("id") * 7 % 4001).cast("double").alias("b"), (F.col("id") > 2000).cast("double").alias("y"), F.lit(1).alias("w"))
    best = {r["node"]: r["feature"] for r in ml.best_splits(rows, ["a", "b"], "y", [0.0, 1.0], "node", "w", drawn).collect()}
    assert best == {0: "a", 1: "b", 2: "a", 3: "b"}
    assert asked.value <= 16


def test_generated_files_are_dealt_to_all_cores(spark, tmp_path):
    """A small table has one part, but a file of code is generated and parsed for each of its rows."""
    spark.range(40).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    parts = lambda rows: rows.rdd.getNumPartitions()
    assert parts(fixtures.generated(spark, str(tmp_path))) == 4
    assert parts(fixtures.ruled(spark, str(tmp_path))) == 4
    one = fixtures.package(spark).coalesce(1)
    assert parts(code_graph._with_modules(one)) == 4


def test_graphs_send_only_very_small_tables_through_the_driver(spark):
    """Their joins follow a lower threshold than the session's, which stands again afterwards."""
    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(key)
    graph = code_graph.build(fixtures.package(spark))
    assert spark.conf.get(key) == before
    lineage.joined_in_tasks(lambda rows: seen.append(rows.sparkSession.conf.get(key)))(graph.nodes)
    assert seen == [lineage.SENT] and all(hasattr(f, "__wrapped__") for f in (code_graph.build, code_graph.update))


def test_scores_of_a_batch_are_held_in_bounded_parts():
    """Not rows of a batch times questions of a block at once."""
    for rows, questions in ((10_000, 2048), (7, 1 << 21), (5, 0), (0, 3)):
        parts = list(question_search._pieces(rows, questions))
        assert sum(n for _, n in parts) == rows and [s for s, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert all(n == 1 or n * questions <= question_search.HELD_SCORES for _, n in parts)


def test_cells_outside_a_stored_part_are_dealt_to_all_tasks(spark):
    """They have no null key in the join."""
    a = spark.range(4000).select(F.array("id", F.lit(0).cast("long")).alias("at"), F.lit(1.0).alias("v"))
    value = spark.createDataFrame([([0], 5.0)], "at array<long>, v double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = arrays.stored(a, (4000, 1), [-1, slice(None)], value).withColumn("task", F.spark_partition_id())
        assert max(r["count"] for r in out.groupBy("task").count().collect()) < 2000
        assert [r["at"] for r in out.filter("v = 5").collect()] == [[3999, 0]]
        assert out.count() == 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_length_is_computed_once_a_vector(spark):
    """Not for each of its numbers."""
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None])], "id long, v array<float>")
    plan = lambda c: rows.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"/ \(?\(?SQRT\(", plan(vectors.normalised(F.col("v"))), re.I)
    got = [r["n"] for r in rows.orderBy("id").select(vectors.normalised(F.col("v")).alias("n")).collect()]
    assert got == [[3 / (5 + 1e-8), 4 / (5 + 1e-8)], None, [0.0, 0.0], [None, None]]


def test_words_are_hashed_together():
    """Distinct words of a batch at once, whatever their lengths; the same vectors as word by word."""
    words = ["", "a", "é" * 27, "x" * 55, "x" * 56, "ü" * 28, "y" * 200, *(hashlib.sha256(bytes([i])).hexdigest()[: i % 60] for i in range(256))]
    heads = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in words]
    assert embedding._md5_heads(pa.array(words, pa.large_string())).tolist() == heads
    want = np.zeros((2, 5))
    for w, h in zip(words, heads, strict=True):
        want[1, (h >> 1) % 5] += (1 if h & 1 else -1) * bool(w)
    assert (embedding.HashEmbedder(5).embed(["", " ".join(words).upper().lower()]) == want).all() and embedding.HashEmbedder().embed([]).shape == (0, 64)


def test_texts_are_searched_for_questions_that_they_may_answer(monkeypatch):
    """Not all texts for all terms; both ways give the same scores."""
    terms = [["red", "fox"], ["fox", "lake", "heron"], []]
    block = question_search._Block(pd.DataFrame({"query_id": range(3), "normed": [[1.0, 0.0]] * 3, "terms": terms}))
    block.weigh(np.array([{"red": 1, "fox": 3, "lake": 2, "heron": 0}[t] for t in block.terms]), 4, 0.12)
    hays = pa.array(["a red fox", "foxes by a lake", None, "heron and fox and lake", "never read"])
    cosines = np.array([[0.3, 0.2, 0.1], [0.0, 0.3, 0.3], [0.5, 0.5, 0.5], [0.3, 0.3, 0.3], [-1, -1, -1]])
    full = cosines + block.boosts(question_search._automaton(block.terms), hays.to_pylist(), 0.1)
    floor = np.array([0.35, 0.35, 0.2])
    for few in (100, -1):
        monkeypatch.setattr(question_search, "FEW_QUESTIONS", few)
        kept, scores = block.boosted(question_search._automaton(block.terms), hays, cosines.copy(), floor - block.bounds(0.1), 0.1)
        assert kept.tolist() == [0, 1, 2, 3]
        assert np.allclose(np.where(scores >= floor, scores, 0), np.where(full[:4] >= floor, full[:4], 0))


def test_a_question_is_normalised_once(spark):
    """Not in the plan, where it would be for every row (and, until it was a variable, for every number)."""
    rows = spark.createDataFrame([([0.6, 0.8],)], "v array<float>")
    near = rows.select(vector_search.cosine(F.col("v"), [4.0, 3.0]).alias("c"))
    assert "sqrt" not in near._jdf.queryExecution().analyzed().toString().lower()
    assert abs(near.first()["c"] - 0.96) < 1e-6


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_that_meet_a_small_array_stay_where_they_lie(spark):
    """Three keys are no keys to deal cells by: the small array goes to them, and their sums are one row a place."""
    x = np.random.default_rng(3).normal(size=(5, 3))
    x[4, 1] = np.nan
    rows = [([int(i), int(k)], float(v)) for (i, k), v in np.ndenumerate(x) if v == v]
    a = spark.createDataFrame(rows, "at array<long>, v double")
    b = spark.createDataFrame([([0, 0], 2.0), ([1, 0], 3.0), ([1, 1], -1.0), ([2, 2], None)], "at array<long>, v double")
    units = spark.createDataFrame([([k], 2.0 * k) for k in range(3)], "at array<long>, v double")
    dense = lambda df: sorted((r["at"], None if r["v"] is None else round(r["v"], 9)) for r in df.collect())
    scaled = arrays.combined(a, units, "*", (5, 3), (3,))
    assert "BroadcastHashJoin" in _plan(scaled) and "SortMergeJoin" not in _plan(scaled)
    assert dense(scaled) == [(at, round(v * 2.0 * at[1], 9)) for at, v in sorted(rows)]
    product = arrays.multiplied(a, b, 2, 2, (3, 3))
    assert "SortMergeJoin" not in _plan(product) and dense(product) == dense(arrays.multiplied(a, b, 2, 2))
    assert dense(product)[-1] == ([4, 2], None), "a null cell is there, and counts as nothing"
    for last in (3, 3000):  # in a row, and by a join
        pairs = arrays.gram(a, 2, last)
        assert dense(pairs) == dense(arrays.multiplied(arrays.permuted(a, [1, 0]), a, 2, 2))
    assert arrays.gram(a.filter("false"), 2, 3).isEmpty() and arrays.multiplied(a.filter("false"), b, 2, 2, (3, 3)).isEmpty()
    assert arrays.reduced(a.filter("false"), 2, [0, 1]).isEmpty()


def test_reductions_group_where_rows_lie_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """An order's lines lie in one task, tasks grow in number with the table, and no sum of an order is shuffled again."""
    rows = spark.range(3000).select((F.col("id") / 3).cast("long").alias("l_orderkey"), (F.col("id") % 3 + 1).cast("int").alias("l_linenumber"), *(F.lit(1.0).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(array_queries, "LINES_AT_ONCE", 300, raising=False)
    a = array_queries._figures(spark, str(tmp_path))
    assert a.rdd.getNumPartitions() == 10
    for over in ([1], [-1]):
        assert _plan(arrays.reduced(a, 3, over)).count("Exchange") == 1
    assert arrays.reduced(a, 3, [1]).filter("sum = 3 AND std = 0").count() == 3000


def _moved(spark, do):
    """Bytes that the tasks of ``do`` shuffle, and bytes that they write."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        do()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store, out = context.statusTracker(), context._jsc.sc().statusStore(), [0, 0]
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        data = store.lastStageAttempt(stage)
        out[0], out[1] = out[0] + data.shuffleWriteBytes(), out[1] + data.outputBytes()
    return out


def test_a_change_of_the_store_moves_its_rows_once(spark, tmp_path):
    """Texts are not shuffled to find that their files are stored, and changed partitions are dealt and written once."""
    texts = [(f"f{i}", "".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest() for j in range(150))) for i in range(100)]
    uploads = spark.createDataFrame(texts, "file string, text string").repartition(3).cache()
    uploads.count()
    size = sum(len(t) for _, t in texts)
    store = ChunkStore(spark, str(tmp_path / "store"), "file string, text string", parts=4)
    whole = lambda rows: rows.select("file", "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more names than are sent
    try:
        first, again = _moved(spark, lambda: store.add(uploads, whole)), _moved(spark, lambda: store.add(uploads, whole))
        assert first[0] < 1.5 * size and again[0] < size / 10 and again[1] == 0
        part = uploads.filter("file LIKE 'f1%'")
        changed = _moved(spark, lambda: store.replace(part.withColumn("text", F.concat("text", F.lit("!"))), whole))
        gone = _moved(spark, lambda: store.remove(uploads.filter("file LIKE 'f2%'")))
        assert max(changed + gone) < 1.5 * size
        more = spark.createDataFrame([("g", "new"), ("f3", "not stored again")], "file string, text string")
        store.add(more, whole)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(f, t + "!" * f.startswith("f1")) for f, t in texts if not f.startswith("f2")] + [("g", "new")]
    assert sorted((r.file, r.text) for r in store.chunks().collect()) == sorted(want)
