"""Search without writes, and for tables of questions."""

import numpy as np
import pytest

from lodestone.functions.vectors import normalised
from lodestone.operators import embedding, hybrid, question_search, vector_search

QUESTIONS = ["What is the Red-Fox and the fx?", "badger_den?", "", None, "the red fox in the winter", "heron heron HERON"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(4)
    words = ["red", "fox", "badger-den", "heron", "Winter", "lake", "stone", "fx", "the"]
    rows = [(i, " ".join(rng.choice(words, 12)), f"file_{i % 3}.md") for i in range(120)] + [(200 + i, "heron lake", "x.py") for i in range(4)] + [(300, None, None), (301, "", "Red-Fox.txt")]
    df = spark.createDataFrame(rows, "chunk_id long, text string, file string").repartition(3)
    return embedding.embedded(df.withColumn("embed_text", df["text"]), embedding.HashEmbedder()).select("chunk_id", "text", "file", "normed").cache()


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, q, embedding.HashEmbedder().embed([q or ""])[0].tolist()) for i, q in enumerate(QUESTIONS)]
    df = spark.createDataFrame(rows + [(50, "no vector", None)], "query_id int, query string, v array<float>")
    return df.withColumn("normed", normalised(df["v"])).drop("v")


@pytest.mark.parametrize(("top_k", "use_mmr", "at_once"), [(4, True, 2048), (3, False, 2), (1, True, 1)])
def test_each_question_gets_what_it_gets_alone(spark, chunks, questions, top_k, use_mmr, at_once):
    got = {}
    for r in question_search.search_all(chunks, questions, top_k=top_k, min_score=0.2, use_mmr=use_mmr, at_once=at_once).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, round(r.score, 9), r.text))
    for i, q in enumerate(QUESTIONS):
        vector = embedding.HashEmbedder().embed([q or ""])[0].tolist()
        alone = vector_search.search(chunks, q or "", vector, top_k=top_k, min_score=0.2, use_mmr=use_mmr).collect()
        assert sorted(got.get(i, [])) == sorted((r["rank"], r.chunk_id, round(r.score, 9), r.text) for r in alone), q
    assert 50 not in got and len(got) >= 3


def test_search_of_nothing(chunks, questions):
    assert question_search.search_all(chunks, questions.filter("false")).collect() == []
    assert question_search.search_all(chunks.filter("false"), questions).collect() == []
    assert question_search.search_all(chunks, questions, min_score=9.0).collect() == []


def test_shortlists_settle(monkeypatch, spark, chunks, questions):
    want = question_search.search_all(chunks, questions, min_score=0.2).orderBy("query_id", "rank").collect()
    best = question_search._Shortlists(2, 3, 0.1)
    rng = np.random.default_rng(1)
    scores = rng.random((500, 2)).round(2)
    for lo in range(0, 500, 50):
        best.add(np.arange(lo, lo + 50), scores[lo : lo + 50])
        best.settle()
    for q in range(2):
        order = np.lexsort((np.arange(500), -scores[:, q]))[:3]
        assert best.key[best.question == q].tolist() == order.tolist()
    assert want


def test_search_reads_twice_and_writes_nothing(spark, tmp_path, chunks):
    path, kept = str(tmp_path / "chunks"), tmp_path / "kept"
    chunks.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = set(kept.parent.rglob("*"))
    found = vector_search.search(stored, "red fox", embedding.HashEmbedder().embed(["red fox"])[0].tolist(), min_score=0.2, use_mmr=False)
    assert plan(found).count("FileScan parquet") == 1, "the second scan; the first gave the numbers in this plan"
    first = plan(stored.select(vector_search._hay()))
    assert "normed" not in first and "text" in first, "the first scan has no vectors"
    assert found.count() == 4 and set(kept.parent.rglob("*")) == before
    gains = vector_search.term_gains(stored, "red fox")
    assert set(gains) == {"red", "fox"} and all(0 < g < 0.12 for g in gains.values())


def test_contexts_of_many_questions(spark):
    rows = [(1, "vector", 1, "a", "x" * 50), (1, "graph", 1, "g", "y" * 900), (2, "vector", 2, "b", "z" * 2000), (2, "vector", 1, "c", "w" * 10), (3, "graph", 1, "h", "v" * 990)]
    hits = spark.createDataFrame(rows, "query_id int, kind string, rank int, source string, text string")
    got = {r.query_id: r for r in hybrid.build_context(hits, 1000, ["query_id"]).collect()}
    for key, own in got.items():
        alone = hybrid.build_context(hits.filter(f"query_id = {key}"), 1000).first()
        assert (own.context, own.sources, own.n_graph, own.n_vector, own.truncated) == tuple(alone)
    assert got[1].truncated and got[2].n_vector == 2 and got[3].n_graph == 1
