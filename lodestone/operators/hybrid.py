"""Hybrid search and the packing of its hits into one context under a budget of characters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.plans.lineage import written

HEADERS = {"graph": "## Code relations", "vector": "## Passages"}
CUT_NOTE = "\n… (cut)"


@dataclass
class Hits:
    """Hits of both sides (``kind, rank, source, text, score, node``) and what went wrong."""

    rows: DataFrame | None
    errors: list[str] = field(default_factory=list)


def hybrid_search(sides: dict[str, Callable[[], DataFrame] | None]) -> Hits:
    """Run the sides that there are; a side that fails becomes an error and the others' hits stay."""
    rows, errors = None, []
    for kind, side in sides.items():
        if side is None:
            continue
        try:
            got = written(side().withColumn("kind", F.lit(kind)))
        except Exception as e:  # noqa: BLE001 whatever a side raises is reported, not lost
            errors.append(f"{kind.capitalize()}: {e}")
            continue
        rows = got if rows is None else rows.unionByName(got, allowMissingColumns=True)
    return Hits(rows, errors)


STATE = "struct<used:int,first:boolean,truncated:boolean,blocks:array<string>,sources:array<string>>"


def _fold(blocks: Column, used: Column, budget: Column, header: str, tag: str) -> Column:
    """Place blocks in order: what does not fit is cut if there is room for LEAST_ROOM characters, else skipped."""
    start = F.struct(used.alias("used"), F.lit(True).alias("first"), F.lit(False).alias("truncated"), F.array().cast("array<string>").alias("blocks"), F.array().cast("array<string>").alias("sources")).cast(STATE)

    def place(s: Column, b: Column) -> Column:
        block = F.concat(F.lit("["), b["source"], F.lit("]\n"), b["text"])
        head = F.when(s["first"], len(header) + 2).otherwise(0)
        room = budget - s["used"] - head - 2
        fits, cut = F.length(block) <= room, room >= settings.LEAST_ROOM
        body = F.when(fits, block).otherwise(F.concat(F.substr(block, F.lit(1), room - len(CUT_NOTE)), F.lit(CUT_NOTE)))
        placed = F.struct(
            (s["used"] + head + F.length(body) + 2).alias("used"),
            F.lit(False).alias("first"),
            (s["truncated"] | ~fits).alias("truncated"),
            F.array_append(s["blocks"], F.when(s["first"], F.concat(F.lit(header + "\n\n"), body)).otherwise(body)).alias("blocks"),
            F.array_append(s["sources"], F.concat(F.lit(tag), b["source"])).alias("sources"),
        ).cast(STATE)
        skipped = F.struct(s["used"].alias("used"), s["first"].alias("first"), F.lit(True).alias("truncated"), s["blocks"].alias("blocks"), s["sources"].alias("sources")).cast(STATE)
        return F.when(fits | cut, placed).otherwise(skipped)

    return F.aggregate(blocks, start, place)


def build_context(hits: DataFrame, most: int = settings.HYBRID_CONTEXT_CHARS, keys: Sequence[str] = ()) -> DataFrame:
    """``context, sources, n_graph, n_vector, truncated`` from ``hits(kind, rank, source, text)``: one row for each value of ``keys``.

    Without keys all hits are one question's: one row, also of no hits.  Graph blocks may take 60 % of the budget (all of it if there are no passages); passages take what is left.
    """

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "source", "text"))))

    lists = hits.groupBy(*keys).agg(of("graph").alias("g"), of("vector").alias("v"))
    share = F.when(F.size("v") > 0, int(most * settings.HYBRID_GRAPH_SHARE)).otherwise(most)
    graph = lists.withColumn("gs", _fold(F.col("g"), F.lit(0), share, HEADERS["graph"], "graph: "))
    both = graph.withColumn("vs", _fold(F.col("v"), F.col("gs.used"), F.lit(most), HEADERS["vector"], "vector: "))
    return both.select(
        *keys,
        F.array_join(F.concat("gs.blocks", "vs.blocks"), "\n\n").alias("context"),
        F.array_sort(F.array_distinct(F.concat("gs.sources", "vs.sources"))).alias("sources"),
        F.size("gs.blocks").alias("n_graph"),
        F.size("vs.blocks").alias("n_vector"),
        (F.col("gs.truncated") | F.col("vs.truncated")).alias("truncated"),
    )


def plain_context(hits: DataFrame, *keys: str) -> DataFrame:
    """All hits in order, without a budget; one row for each value of ``keys``, if there are any."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))), lambda b: F.concat(F.lit("["), b["source"], F.lit("]\n"), b["text"]))
    return hits.groupBy(*keys).agg(F.array_join(blocks, "\n\n").alias("context"))
