"""Operator 4: exact top-k by exhaustive term-at-a-time accumulation.

A vector's terms are its components, each quantised to ``floor(1024 x)``.  Queries are
broadcast in blocks of bounded size, and candidates are read where they lie: in each
of their partitions the query rows' non-zero terms scatter ``weight * posting`` into
dense score arrays, some thousand candidates at a time, a partition selection keeps
the k best, and the lists merge, first in the partition, then by query.  No candidate
is shuffled, and a partition gives k rows for each query, whatever it holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.tables import map_batches, stored, table

SCALE = 1024
#: Bytes of the query terms that are broadcast at once, about.
QUERY_BYTES = 32 << 20
#: Candidates and queries of one dense score array.
CANDIDATES_AT_ONCE, QUERIES_AT_ONCE = 8192, 64

HITS = "query_id long, vec_id long, score long"


def usable(embedding: Column) -> Column:
    """A vector with at least one component, all of them finite."""
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)))


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _matrix(terms: pa.Array) -> np.ndarray:
    """Terms by rows; terms that a vector lacks weigh nothing."""
    sizes = np.diff(terms.offsets.to_numpy())
    values = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out.T


def _scores(weights: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Inner products, a term's postings at a time for the queries that have it; beyond 64 bits they stay at the bound."""
    terms = min(len(weights), len(postings))
    most = [max(abs(int(x.min(initial=0))), int(x.max(initial=0))) for x in (weights, postings)]
    wide = terms * most[0] * most[1] >= 1 << 63
    if wide:
        weights, postings = weights.astype(object), postings.astype(object)
    scores = np.zeros((weights.shape[1], postings.shape[1]), weights.dtype)
    for term in range(terms):
        has = np.flatnonzero(weights[term])
        if len(has) == len(scores):
            scores += weights[term, :, None] * postings[term]
        elif len(has):
            scores[has] += weights[term, has, None] * postings[term]
    return np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64) if wide else scores


class _Best:
    """The k highest scores of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.found = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * queries

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates in the order of their ids."""
        k = self.k
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = np.flatnonzero(scores > least)
            keep = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])  # ties to the smaller id
            ids, scores = ids[keep], scores[keep]
        held = self.found[query]
        ids, scores = np.concatenate([held[0], ids]), np.concatenate([held[1], scores])
        order = np.lexsort([ids, -scores.astype(object) if scores.min(initial=0) == -(1 << 63) else -scores])[:k]
        self.found[query] = ids[order], scores[order]


def _scan(candidates: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """Each partition's best for the queries (ids and weights, ``shared``); ``candidates(id, terms)`` stay where they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        best, held, n = _Best(len(own), k), [], 0

        def score() -> None:
            rows = pa.Table.from_batches(held).combine_chunks().sort_by("id").combine_chunks()
            ids, postings = rows["id"].to_numpy(), _matrix(rows["terms"].chunk(0))
            for lo in range(0, len(own), QUERIES_AT_ONCE):
                scores = _scores(weights[:, lo : lo + QUERIES_AT_ONCE], postings)
                for q, row in enumerate(scores, lo):
                    s, e = np.searchsorted(ids, own[q]), np.searchsorted(ids, own[q], "right")
                    if s == e:
                        best.add(q, ids, row)
                    else:
                        best.add(q, np.delete(ids, np.s_[s:e]), np.delete(row, np.s_[s:e]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= CANDIDATES_AT_ONCE:
                score()
                held, n = [], 0
        if n:
            score()
        sizes = [len(i) for i, _ in best.found]
        if sum(sizes):
            columns = (np.repeat(own, sizes), *(np.concatenate(x) for x in zip(*best.found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return map_batches(candidates.select("id", "terms"), work, HITS)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products among candidates of other ids.

    Both tables have ``id long, terms array<long>``; other columns are not read.  Ids are taken to be unique (repeated
    ids are scored as rows of their own, and a query meets none of its own id).  Ties go to the smaller id.  Fewer
    candidates than ``k`` give fewer ranks; empty tables give none.  Scores beyond 64 bits stay at the bound.
    """
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n * max(width, 1) * 8 // QUERY_BYTES))
    rows = queries.select("id", "terms")
    if blocks > 1:
        rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("id", "terms"), F.lit(blocks))))
    found = []
    for i in range(blocks):
        block = (rows.filter(F.col("block") == i) if blocks > 1 else rows).select("id", "terms").toArrow().combine_chunks()
        if block.num_rows:
            shared = queries.sparkSession.sparkContext.broadcast((block["id"].to_numpy(), _matrix(block["terms"].chunk(0))))
            hits = _scan(candidates, shared, k)
            if blocks > 1:  # one block after the other: only its hits stay
                hits = stored(hits)
                shared.unpersist()
            found.append(hits)
    hits = reduce(DataFrame.unionByName, found) if found else queries.sparkSession.createDataFrame([], HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 100; vectors that are null or hold null or non-finite components take no part."""
    vectors = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("terms"))
    return top_k(vectors.filter(F.col("id") % 100 == 0), vectors, 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
terms AS (SELECT vec_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM v),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM terms q JOIN terms c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY ALL
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
