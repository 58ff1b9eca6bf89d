"""Search for a table of questions: the chunks are read twice for all of them, not twice for each.

The first scan has texts and names alone: one automaton over the terms of all questions finds every term in a text at
once, and document frequencies are counts by term, summed before they are shuffled.  The second scan has vectors too:
cosines with all questions are one matrix product a batch, and the automaton's hits add each question's gains.  A task
keeps no more than the shortlist of each question, and once it is full only what beats its last entry; a text is not
searched for the terms of a question whose shortlist it could not enter with all of them.  Shortlists meet by question,
and the diverse choice is made in each group of at most ``fetch_k`` rows.

Questions come in blocks of a fixed number, one block after the other: what is shipped to tasks (vectors, terms, gains)
and what a block's shortlists hold are bounded, however many questions there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.functions.text import query_terms
from lodestone.operators.vector_search import _hay, mmr_order
from lodestone.plans.lineage import written

#: Questions asked at once, about (they are dealt by a hash).
QUESTIONS_AT_ONCE = 2048
#: Scores that a task holds before it keeps the best of each question alone.
HELD_SCORES = 1 << 20
#: Rows scored at once: between them floors rise.
ROWS_AT_ONCE = 1024
#: A text that may enter the shortlists of no more questions is searched for their terms alone.
FEW_QUESTIONS = 12


def _automaton(terms: list[str]):
    """Finds all terms in a text in one pass; none for no terms."""
    if not terms:
        return None
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(t, i)
    found.make_automaton()
    return found


def _term_hits(automaton, hays: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``row, term``: which of the terms each text has."""
    if automaton is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [{i for _, i in automaton.iter(h)} if h else () for h in hays]
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    return row, np.fromiter((t for f in found for t in f), np.int64, len(row))


def document_frequencies(chunks: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """How many of ``chunks(text, file)`` have each (folded) term, and how many there are: one scan of texts and names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = _automaton(terms), np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            counts[-1] += batch.num_rows
            counts[:-1] += np.bincount(_term_hits(automaton, batch.column(0).to_pylist())[1], minlength=len(terms))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["term", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    for r in chunks.select(_hay()).mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


class _Block:
    """A block of questions: vectors, and the gains of its terms by question (compressed by term)."""

    def __init__(self, rows: pd.DataFrame):
        self.ids = rows["query_id"].to_numpy()
        self.vectors = np.array(rows["normed"].tolist(), np.float64).reshape(len(rows), -1)
        of_term: dict[str, list[int]] = {}
        for i, terms in enumerate(rows["terms"]):
            for t in terms:
                of_term.setdefault(t, []).append(i)
        self.terms = list(of_term)
        self.first = np.cumsum([0, *(len(q) for q in of_term.values())])
        self.asking = np.array([i for q in of_term.values() for i in q], np.int64)
        self.gain = np.zeros(len(self.terms))
        self.of_question: list[list[tuple[str, float]]] = [[] for _ in self.ids]

    def weigh(self, df: np.ndarray, n: int, per_term: float) -> None:
        self.gain = np.where(df > 0, per_term * (1 - df / max(n, 1)), 0.0)
        for term in np.argsort(-df, kind="stable"):
            for i in self.asking[self.first[term] : self.first[term + 1]]:
                self.of_question[i].append((self.terms[term], float(self.gain[term])))

    def bounds(self, most: float) -> np.ndarray:
        """What a text may add for each question at most; a little more, as sums in other orders may differ by that."""
        return np.minimum(np.bincount(self.asking, np.repeat(self.gain, np.diff(self.first)), len(self.ids)), most) + 1e-9

    def boosts(self, automaton, hays: list[str | None], most: float) -> np.ndarray:
        """``[text, question]``."""
        out = np.zeros((len(hays), len(self.ids)))
        row, term = _term_hits(automaton, hays)
        many = self.first[term + 1] - self.first[term]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[term], many)
        np.add.at(out, (np.repeat(row, many), self.asking[place]), np.repeat(self.gain[term], many))
        return np.minimum(out, most)

    def boosted(self, automaton, hays: pa.Array, scores: np.ndarray, least: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a cosine of ``least`` or more for some question, and their scores; other texts are not looked at.

        Scores of other questions may be left at minus infinity.
        """
        near = scores >= least
        kept = np.flatnonzero(near.any(axis=1))
        near, scores, some = near[kept], scores[kept], hays.take(pa.array(kept)).to_pylist()
        if near.sum() > FEW_QUESTIONS * len(kept):
            return kept, scores + self.boosts(automaton, some, most)
        scores[~near] = -np.inf
        for i, q in zip(*np.nonzero(near), strict=True):
            scores[i, q] += self.boost(some[i], q, most)
        return kept, scores

    def boost(self, hay: str | None, question: int, most: float) -> float:
        """One text for one question: its terms, frequent ones first, until nothing can be added."""
        found = 0.0
        for term, gain in self.of_question[question]:
            if hay and term in hay:
                found += gain
                if found >= most:
                    return most
        return found


class _Shortlists:
    """The best chunks of each question of a task: score first, then the smaller id."""

    def __init__(self, questions: int, size: int, floor: float):
        self.size, self.floor = size, np.full(questions, floor)
        self.question, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        row, question = np.nonzero(scores >= self.floor)
        self.parts.append((question, keys[row], scores[row, question]))
        self.held += len(row)
        if self.held > min(HELD_SCORES, 4 * self.size * len(self.floor)):  # early, as a floor spares texts
            self.settle()

    def settle(self) -> None:
        self.question, self.key, self.score = (np.concatenate(x) for x in zip((self.question, self.key, self.score), *self.parts, strict=True))
        order = np.lexsort((self.key, -self.score, self.question))
        question = self.question[order]
        rank = np.arange(len(order)) - np.searchsorted(question, question)
        best = order[rank < self.size]
        last = order[rank == self.size - 1]
        self.floor[self.question[last]] = self.score[last]
        self.question, self.key, self.score = self.question[best], self.key[best], self.score[best]
        self.parts, self.held = [], 0


def _pieces(rows: int, questions: int) -> Iterator[tuple[int, int]]:
    """``start, many`` of a batch's parts: a part has no more scores than a task holds, whatever the batch and the block."""
    step = max(1, min(ROWS_AT_ONCE, HELD_SCORES // max(questions, 1)))
    yield from ((start, min(step, rows - start)) for start in range(0, rows, step))


def _shortlists(chunks: DataFrame, block: _Block, fetch_k: int, min_score: float, most: float, boost: bool) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``fetch_k`` best chunks of each question of a block: one scan."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, best = _automaton(block.terms if boost else []), _Shortlists(len(block.ids), fetch_k, min_score)
        bounds = block.bounds(most)
        for batch in batches:
            if not batch.num_rows:
                continue
            for start, many in _pieces(batch.num_rows, len(block.ids)):
                piece = batch.slice(start, many)
                vectors = piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(many, -1)
                scores, keys = vectors @ block.vectors.T, piece.column(0).to_numpy()
                if boost:
                    kept, scores = block.boosted(automaton, piece.column(1), scores, best.floor - bounds, most)
                    keys = keys[kept]
                best.add(keys, scores)
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[best.question], pa.int64()), pa.array(best.key, pa.int64()), pa.array(best.score)], ["query_id", "chunk_id", "score"])

    hay = _hay() if boost else F.lit(None).cast("string").alias("__hay")
    scored = chunks.filter("normed IS NOT NULL").select(F.col("chunk_id").cast("long"), hay, "normed").mapInArrow(work, "query_id long, chunk_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= fetch_k)


def search_all(
    chunks: DataFrame, questions: DataFrame, top_k: int = 4, min_score: float = 0.3, use_mmr: bool = True, mmr_lambda: float = 0.7, fetch_k: int | None = None,
    boost: bool = True, most: float = settings.MAX_BOOST, per_term: float = settings.BOOST_PER_TERM, at_once: int = QUESTIONS_AT_ONCE,
) -> DataFrame:
    """``query_id, rank, score`` and the columns of ``chunks`` for every row of ``questions(query_id, query, normed)``.

    Each question gets what :func:`vector_search.search` gives it alone.  ``chunk_id`` and ``query_id`` are distinct
    integers; questions whose vector is null, and those without a chunk above the threshold, have no rows; a null question
    text has no terms.  No questions, or no chunks, give an empty table.
    """
    top_k = max(1, top_k)
    fetch_k = max(fetch_k or 4 * top_k, top_k) if use_mmr else top_k
    asked = questions.filter("normed IS NOT NULL AND query_id IS NOT NULL").select(F.col("query_id").cast("long"), "normed", F.coalesce(query_terms(F.col("query")), F.array().cast("array<string>")).alias("terms"))
    blocks = max(1, -(-asked.count() // at_once))
    found = []
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()  # about at_once rows
        if not len(rows):
            continue
        block = _Block(rows)
        if boost and block.terms:
            block.weigh(*document_frequencies(chunks, block.terms), per_term)
        short = _shortlists(chunks, block, fetch_k, min_score, most, boost)
        # fetch_k rows of at_once questions: small whatever the chunks, so they go to the chunks, not the chunks to them.
        found.append(_chosen(chunks, written(short), top_k, mmr_lambda, use_mmr))
        if blocks > 1:
            found[-1] = written(found[-1])
    if not found:
        none = chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        return _chosen(chunks, none, top_k, mmr_lambda, use_mmr)
    return reduce(DataFrame.unionByName, found)


def _chosen(chunks: DataFrame, short: DataFrame, top_k: int, mmr_lambda: float, use_mmr: bool) -> DataFrame:
    own = [c for c in chunks.columns if c != "chunk_id"]
    rows = chunks.join(F.broadcast(short), "chunk_id")
    if not use_mmr:
        return rows.select("query_id", "rank", "score", "chunk_id", *(F.col(f"`{c}`") for c in own))
    fields = F.struct("rank", "score", "chunk_id", *(F.col(f"`{c}`") for c in own))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(fields)).alias("s"))
    picked = lists.select("query_id", "s", F.posexplode(mmr_order(F.col("s"), top_k, mmr_lambda)).alias("n", "i"))
    hit = picked.select("query_id", (F.col("n") + 1).alias("rank"), F.get("s", F.col("i")).alias("hit"))
    return hit.select("query_id", "rank", F.col("hit.score").alias("score"), F.col("hit.chunk_id").alias("chunk_id"), *(F.col("hit")[c].alias(c) for c in own))
