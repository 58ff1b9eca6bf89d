"""Vector search: cosine, keyword boost, threshold, shortlist and maximal marginal relevance.

``chunks`` has ``chunk_id``, ``normed`` and what a caller wants to keep; the keyword boost also reads
``text`` and ``file``.  Scores are one Catalyst plan over the chunks; only a shortlist of ``4 k`` rows
is gathered for the diverse choice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.functions.text import folded, query_terms
from lodestone.functions.vectors import EPSILON, dot


def term_hits(text: Column, file: Column, terms: Column) -> Column:
    """For each term, whether it occurs (as a substring) in the folded text or file name."""
    hay = F.concat(folded(text), F.lit(" "), folded(file))
    return F.transform(terms, lambda t: F.contains(hay, t))


def _found(rows: DataFrame, terms: Sequence[str]) -> list[Column]:
    """For each term, whether it occurs in the column ``__hay`` of ``rows``."""
    return [F.contains(rows["__hay"], F.lit(t)) for t in terms]


def _hay(text: str = "text", file: str = "file") -> Column:
    return F.concat(folded(text), F.lit(" "), folded(file)).alias("__hay")


def term_gains(chunks: DataFrame, query: str, per_term: float = settings.BOOST_PER_TERM) -> dict[str, float]:
    """What each term of a question that occurs adds: ``per_term * (1 - df / n)``.

    One scan of texts and file names alone, and one row of counts (a number for each term of the question).
    """
    terms = chunks.sparkSession.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]
    if not terms:
        return {}
    hay = chunks.select(_hay())
    counts = hay.agg(F.count("*").alias("n"), *(F.sum(hit.cast("long")).alias(f"t{i}") for i, hit in enumerate(_found(hay, terms)))).first()
    return {t: per_term * (1 - counts[f"t{i}"] / counts["n"]) for i, t in enumerate(terms) if counts["n"] and counts[f"t{i}"]}


def keyword_boost(chunks: DataFrame, query: str, most: float = settings.MAX_BOOST, per_term: float = settings.BOOST_PER_TERM, keep: list[str] | None = None, gains: dict[str, float] | None = None) -> DataFrame:
    """``chunks`` (or the columns ``keep``) with ``boost``: the gains of the terms found, ``most`` at most.

    Nothing is written: the terms' gains (:func:`term_gains`) are numbers in the plan, which reads the chunks a second time.
    """
    gains = term_gains(chunks, query, per_term) if gains is None else gains
    if not gains:
        return chunks.select(*(F.col(f"`{c}`") for c in keep or chunks.columns), F.lit(0.0).alias("boost"))
    rows = chunks.select(*(F.col(f"`{c}`") for c in keep or chunks.columns), _hay())
    parts = [F.when(hit, F.lit(g)).otherwise(0.0) for hit, g in zip(_found(rows, list(gains)), gains.values(), strict=True)]
    return rows.withColumn("boost", F.least(reduce(Column.__add__, parts), F.lit(most))).drop("__hay")


def cosine(normed: Column, query: Sequence[float]) -> Column:
    """Cosine with a question's vector; both lengths have the small number added."""
    size = math.sqrt(reduce(lambda acc, x: acc + float(x) * float(x), query, 0.0)) + EPSILON  # here: a plan would compute it for every row
    return dot(normed, F.array(*(F.lit(float(x) / size) for x in query)))


def ranked(scored: DataFrame, k: int, by: str = "score", key: str = "chunk_id") -> DataFrame:
    """The ``k`` highest, ties to the smaller key, with ``rank`` from 1."""
    top = scored.orderBy(F.desc(by), key).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(by), key)))


def shortlist(scored: DataFrame, k: int, fetch_k: int | None = None) -> DataFrame:
    """The rows among which the diverse choice is made: ``fetch_k`` best, four times ``k`` unless given, ``k`` at least."""
    return ranked(scored, max(fetch_k or 4 * k, k))


def mmr_order(shortlist: Column, k: int, weight: float) -> Column:
    """Indices into ``array<struct<score, normed, ...>>`` (best first), chosen one by one.

    The first is the best; each next maximises ``weight * score - (1 - weight) * highest cosine to those chosen``.
    """
    weight = min(max(weight, 0.0), 1.0)
    many = F.size(shortlist)
    others = F.sequence(F.lit(0), many - 1)

    def pick(chosen: Column, _: Column) -> Column:
        def value(j: Column) -> Column:
            near = F.array_max(F.transform(chosen, lambda i: dot(F.get(shortlist, i)["normed"], F.get(shortlist, j)["normed"])))
            return F.struct((-(F.lit(weight) * F.get(shortlist, j)["score"] - F.lit(1 - weight) * near)).alias("loss"), j.alias("j"))

        left = F.filter(others, lambda j: ~F.array_contains(chosen, j))
        best = F.array_min(F.transform(left, value))
        return F.when(F.size(left) == 0, chosen).otherwise(F.array_append(chosen, best["j"]))

    first = F.array(F.lit(0))
    return F.when(many > 0, F.aggregate(F.sequence(F.lit(2), F.lit(k)), first, pick) if k > 1 else first)


def search(chunks: DataFrame, query: str, vector: Sequence[float], top_k: int = 4, min_score: float = 0.3, use_mmr: bool = True, mmr_lambda: float = 0.7, fetch_k: int | None = None, boost: bool = True) -> DataFrame:
    """``rank``, ``score`` and the columns of ``chunks``: the best chunks for a question; none above the threshold, no rows.

    ``score`` is cosine plus boost (it may exceed 1) also where the diverse choice decides the order.  The chunks are
    read twice, once for texts and names alone, and nothing is written; :func:`question_search.search_all` answers many
    questions in the same two scans.
    """
    top_k = max(1, top_k)
    near = chunks.withColumn("__cosine", cosine(F.col("normed"), vector))
    if boost:
        # No boost lifts a cosine by more than its bound, so rows below that go before their texts are looked at.
        near = near.filter(F.col("__cosine") >= min_score - settings.MAX_BOOST)
        rows = keyword_boost(near, query, gains=term_gains(chunks, query))
    else:
        rows = near.withColumn("boost", F.lit(0.0))
    scored = rows.withColumn("score", F.col("__cosine") + F.col("boost")).drop("__cosine").filter(F.col("score") >= min_score)
    if not use_mmr:
        return ranked(scored, top_k)
    short = shortlist(scored, top_k, fetch_k)
    own = [c for c in short.columns if c != "rank"]
    gathered = short.agg(F.array_sort(F.collect_list(F.struct("rank", "score", "normed", *(c for c in own if c not in ("score", "normed"))))).alias("s"))
    chosen = gathered.select("s", F.posexplode(mmr_order(F.col("s"), top_k, mmr_lambda)).alias("n", "i"))
    return chosen.select(F.get("s", F.col("i")).alias("hit"), (F.col("n") + 1).alias("rank")).select(*(F.col("hit")[c].alias(c) for c in own), "rank")
