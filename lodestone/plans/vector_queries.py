"""Cosine search and its parts on the embeddings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import query_prefix
from lodestone.functions.vectors import dot, normalised
from lodestone.operators import embedding, question_search, vector_search
from lodestone.plans.lineage import written
from lodestone.plans.registry import Registry, table
from lodestone.plans.text_queries import _CHUNKS, _HITS, _TERMS, QUESTION, document_chunks

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_V = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS u FROM v),
q AS (SELECT u AS qu FROM n WHERE vec_id = 0),
s AS (SELECT vec_id, label, u, list_dot_product(u, qu) AS score FROM n, q)
"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", normalised(F.col("embedding")).alias("normed"))


def _question(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


@query(f"WITH {_V} SELECT vec_id, round(list_sum(u), 6) AS total, round(sqrt(list_dot_product(u, u)), 6) AS size FROM n")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("normed", F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate("normed", F.lit(0.0), lambda a, x: a + x * x))
    return _chunks(spark, d).select(F.col("chunk_id").alias("vec_id"), F.round(total, 6).alias("total"), F.round(size, 6).alias("size"))


@query(f"WITH {_V} SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = _chunks(spark, d).withColumn("score", vector_search.cosine(F.col("normed"), _question(spark, d)))
    return vector_search.ranked(scored, 10).select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_V} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.1")
def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    scored = _chunks(spark, d).withColumn("score", vector_search.cosine(F.col("normed"), _question(spark, d)))
    return scored.filter("score >= 0.1").select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"""
WITH {_V}, p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.u, b.u) AS score FROM n a, n b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5
""")
def cosine_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """Questions: every vector whose id is divisible by 20."""
    chunks = _chunks(spark, d)
    asked = chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.lit(None).cast("string").alias("query"), "normed")
    found = question_search.search_all(chunks, asked, top_k=5, min_score=-2.0, use_mmr=False, boost=False)
    return found.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


def _picks(k: int) -> str:
    """The diverse choice, unrolled: one pick after the other."""
    out = ["short AS (SELECT vec_id, u, score FROM s WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 16)", "p1 AS (SELECT vec_id, u, score, 1 AS rank FROM short ORDER BY score DESC, vec_id LIMIT 1)"]
    for i in range(2, k + 1):
        out.append(f"""c{i} AS (SELECT x.vec_id, x.u, x.score, 0.7 * x.score - 0.3 * max(list_dot_product(x.u, p.u)) AS m FROM short x, p{i - 1} p
  WHERE x.vec_id NOT IN (SELECT vec_id FROM p{i - 1}) GROUP BY x.vec_id, x.u, x.score),
p{i} AS (SELECT * FROM p{i - 1} UNION ALL (SELECT vec_id, u, score, {i} AS rank FROM c{i} ORDER BY m DESC, score DESC, vec_id LIMIT 1))""")
    return ",\n".join(out)


@query(f"WITH {_V}, {_picks(4)} SELECT vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM p4")
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    found = vector_search.search(_chunks(spark, d), "", _question(spark, d), top_k=4, min_score=0.1, boost=False)
    return found.select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_V} SELECT vec_id, round(score, 6) AS score, 1 AS rank FROM s ORDER BY s.score DESC, vec_id LIMIT 1")
def search_clamped(spark: SparkSession, d: str) -> DataFrame:
    """No fewer than one hit is looked for."""
    found = vector_search.search(_chunks(spark, d), "", _question(spark, d), top_k=0, min_score=-2.0, use_mmr=False, boost=False)
    return found.select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_V}, short AS (SELECT vec_id, u FROM s ORDER BY score DESC, vec_id LIMIT 16)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 6) AS cosine FROM short a, short b WHERE a.vec_id < b.vec_id
""")
def shortlist_pairs(spark: SparkSession, d: str) -> DataFrame:
    scored = _chunks(spark, d).withColumn("score", vector_search.cosine(F.col("normed"), _question(spark, d)))
    short = vector_search.shortlist(scored, 4).select("chunk_id", "normed")
    a, b = (short.select(F.col("chunk_id").alias(n), F.col("normed").alias(f"v{n}")) for n in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("cosine"))


def _hashed(rows: str, key: str, text: str, name: str) -> str:
    """SQL of the offline embedder: table ``name`` with ``e``, the vector of each row's text, and ``u``, normalised."""
    return rf"""
{name}_tok AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '\s+')) AS w FROM {rows}) WHERE w <> '' GROUP BY ALL),
{name}_hash AS (SELECT DISTINCT w, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM {name}_tok),
{name}_cell AS (SELECT {key}, (h >> 1) % 64 AS j, sum(CASE WHEN h % 2 = 1 THEN n ELSE -n END)::DOUBLE AS v FROM {name}_tok JOIN {name}_hash USING (w) GROUP BY ALL),
{name}_grid AS (SELECT {key}, unnest(range(64)) AS j FROM {rows}),
{name}_dense AS (SELECT {key}, list(coalesce(v, 0) ORDER BY j) AS e FROM {name}_grid LEFT JOIN {name}_cell USING ({key}, j) GROUP BY {key}),
{name} AS (SELECT *, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS u FROM {name}_dense)"""


_PIECES = f"{_CHUNKS}, pieces AS (SELECT doc_id * 2147483648 + start AS chunk_id, source, piece FROM chunks)"


@query(f"WITH {_PIECES}, {_hashed('pieces', 'chunk_id', 'piece', 'v')} SELECT chunk_id, CAST(unnest(range(64)) AS INTEGER) AS pos, unnest(e) AS x FROM v")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's vector, cell by cell."""
    rows = embedding.embedded(document_chunks(spark, d).select("chunk_id", F.col("text").alias("embed_text")), embedding.HashEmbedder())
    return rows.select("chunk_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"WITH {_hashed('benchmark', 'item_id', 'text', 'v')} SELECT item_id, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(u), 6) AS x FROM v")
def embed_question(spark: SparkSession, d: str) -> DataFrame:
    """Questions one by one: the texts of ``benchmark``."""
    return stored_questions(spark, d).select(F.col("query_id").alias("item_id"), F.posexplode("normed").alias("pos", "x")).withColumn("x", F.round("x", 6))


_STORED: dict[str, DataFrame] = {}


def _once(spark: SparkSession, d: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is ingested once per application, as a store is, and searched many times."""
    key = f"{spark.sparkContext.applicationId} {d} {what}"
    if key not in _STORED:
        _STORED[key] = written(make())
    return _STORED[key]


def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """``chunk_id, doc_id, file, text, normed, model, dim``: the store of all documents' chunks, with the offline embedder."""
    chunks = lambda: embedding.embedded(document_chunks(spark, d).withColumn("embed_text", F.col("text")), embedding.HashEmbedder()).drop("embed_text", "vector")
    return _once(spark, d, "chunks", chunks)


def stored_questions(spark: SparkSession, d: str) -> DataFrame:
    """``query_id, query, normed``: the texts of ``benchmark``."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(query_prefix(F.lit("hash-64")), "text").alias("embed_text"))
    return _once(spark, d, "questions", lambda: embedding.embedded(asked, embedding.HashEmbedder()).select("query_id", "query", "normed"))


@query(f"""
WITH {_PIECES}, {_TERMS}, {_HITS}, asked AS (SELECT 0 AS id, '{QUESTION}' AS t), {_hashed('asked', 'id', 't', 'question')}, {_hashed('pieces', 'chunk_id', 'piece', 'v')},
s AS (SELECT v.chunk_id AS vec_id, v.u, list_dot_product(v.u, question.u) + least(coalesce(g.g, 0), 0.25) AS score FROM question, v LEFT JOIN gains g ON g.chunk_id = v.chunk_id),
{_picks(4)}
SELECT p4.vec_id AS chunk_id, source AS file, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM p4 JOIN pieces ON p4.vec_id = pieces.chunk_id
""")
def search_boosted(spark: SparkSession, d: str) -> DataFrame:
    """The whole of vector search over documents, with the offline embedder."""
    vector = embedding.HashEmbedder().embed([QUESTION])[0].tolist()
    found = vector_search.search(stored_chunks(spark, d), QUESTION, vector, top_k=4, min_score=0.1)
    return found.select("chunk_id", "file", F.round("score", 6).alias("score"), "rank")


def _picks_each(k: int) -> str:
    """The diverse choice for every question: one pick after the other."""
    out = ["""ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0.3),
short AS (SELECT query_id, vec_id, u, score FROM ranked WHERE r <= 16), p1 AS (SELECT query_id, vec_id, u, score, 1 AS rank FROM ranked WHERE r = 1)"""]
    for i in range(2, k + 1):
        out.append(f"""c{i} AS (SELECT x.query_id, x.vec_id, any_value(x.u) AS u, any_value(x.score) AS score, 0.7 * any_value(x.score) - 0.3 * max(list_dot_product(x.u, p.u)) AS m
  FROM short x JOIN p{i - 1} p ON p.query_id = x.query_id WHERE (x.query_id, x.vec_id) NOT IN (SELECT query_id, vec_id FROM p{i - 1}) GROUP BY x.query_id, x.vec_id),
p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT query_id, vec_id, u, score, {i} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, score DESC, vec_id) AS r FROM c{i}) WHERE r = 1)""")
    return ",\n".join(out)


_ASKED = f"""
{_PIECES},
words AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]{{2,}}')) AS w FROM benchmark),
terms AS (SELECT DISTINCT item_id, replace(replace(lower(w), '-', ''), '_', '') AS term FROM words
          WHERE length(replace(replace(lower(w), '-', ''), '_', '')) >= 3
            AND replace(replace(lower(w), '-', ''), '_', '') NOT IN ('the','and','for','how','what','with','this','that','from','does','use','are','who','why')),
hay AS (SELECT chunk_id, replace(replace(lower(piece), '-', ''), '_', '') || ' ' || replace(replace(lower(source), '-', ''), '_', '') AS h FROM pieces),
hits AS (SELECT chunk_id, term FROM hay JOIN (SELECT DISTINCT term FROM terms) ON contains(h, term)),
df AS (SELECT term, 0.12 * (1 - count(*) / CAST((SELECT count(*) FROM pieces) AS DOUBLE)) AS gain FROM hits GROUP BY term),
gains AS (SELECT item_id, chunk_id, least(sum(gain), 0.25) AS g FROM hits JOIN df USING (term) JOIN terms USING (term) GROUP BY item_id, chunk_id),
{_hashed('benchmark', 'item_id', 'text', 'question')},
{_hashed('pieces', 'chunk_id', 'piece', 'v')},
s AS (SELECT q.item_id AS query_id, v.chunk_id AS vec_id, v.u, list_dot_product(v.u, q.u) + coalesce(g, 0) AS score
      FROM question q CROSS JOIN v LEFT JOIN gains ON gains.item_id = q.item_id AND gains.chunk_id = v.chunk_id)
"""


@query(f"""
WITH {_ASKED}, {_picks_each(4)}
SELECT query_id, p4.vec_id AS chunk_id, source AS file, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM p4 JOIN pieces ON p4.vec_id = pieces.chunk_id
""")
def search_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every text of ``benchmark`` as a question to all chunks of documents: boost, threshold, diverse choice."""
    found = question_search.search_all(stored_chunks(spark, d), stored_questions(spark, d), top_k=4)
    return found.select("query_id", "chunk_id", "file", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_ASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2)
SELECT query_id, vec_id AS chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")
def search_questions_plain(spark: SparkSession, d: str) -> DataFrame:
    """The same without the diverse choice."""
    found = question_search.search_all(stored_chunks(spark, d), stored_questions(spark, d), top_k=10, min_score=0.2, use_mmr=False)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")
