"""Chunks of texts: overlapping windows, and the heading under which each starts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import settings
from lodestone.functions.text import strip

_HEADING = re.compile(r"^#{1,6}\s+(.+?)\s*$", re.M)


def steps(text: Column, size: int = settings.CHUNK_CHARS, overlap: int = settings.CHUNK_OVERLAP) -> Column:
    """The stripped text, cut once into pieces of ``size - overlap`` characters: the work is linear in its length."""
    return F.regexp_extract_all(strip(text), F.lit(f"(?s)(.{{1,{max(size - overlap, 1)}}})"), F.lit(1))


def spans(cut: Column, size: int = settings.CHUNK_CHARS, overlap: int = settings.CHUNK_OVERLAP) -> Column:
    """``array<struct<start, piece>>``: windows of ``size`` characters that start every ``size - overlap``.

    ``cut`` is a column of :func:`steps`; a window is its own step and the beginnings of the next.  The last
    window may lie within the one before it.  Blank pieces are left out.
    """
    step = max(size - overlap, 1)
    follow = -(-max(size - step, 0) // step)
    shifted = [F.slice(cut, k + 1, F.greatest(F.size(cut) - k, F.lit(0))).alias(f"s{k}") for k in range(follow + 1)]

    def piece(z: Column, i: Column) -> Column:
        more = [F.substring(F.coalesce(z[f"s{k}"], F.lit("")), 1, min(step, size - k * step)) for k in range(1, follow + 1)]
        return F.struct((i * step).cast("int").alias("start"), strip(F.substring(F.concat(z["s0"], *more), 1, size)).alias("piece"))

    return F.filter(F.transform(F.arrays_zip(*shifted), piece), lambda p: p["piece"] != "")


def chunked(docs: DataFrame, key: str, text: str = "text", size: int = settings.CHUNK_CHARS, overlap: int = settings.CHUNK_OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, ord, start, piece``: a row for each chunk; nulls have none.

    The cut is a projection of its own, so its expression runs once for a text.
    """
    cut = docs.select(key, *keep, steps(F.col(text), size, overlap).alias("__cut"))
    each = cut.select(key, *keep, F.posexplode(spans(F.col("__cut"), size, overlap)).alias("ord", "c"))
    return each.select(key, *keep, "ord", "c.start", "c.piece")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("title", T.StringType())])))
def headings(text: pd.Series) -> pd.Series:
    """Markdown headings with their offsets in the stripped text."""
    return text.map(lambda t: [(m.start(), m.group(1)) for m in _HEADING.finditer((t or "").strip())])


def labelled(docs: DataFrame, file: str, text: str = "text", size: int = settings.CHUNK_CHARS, overlap: int = settings.CHUNK_OVERLAP, titles: Column | None = None) -> DataFrame:
    """``file, ord, start, piece, label``: chunks with ``[file — title]`` of the last heading at or before their start, or ``[file]``.

    An as-of join within each file, by one window over chunks and headings.  ``titles`` (an array of
    ``pos, title``) replaces markdown headings.
    """
    heads = docs.select(F.col(file), F.explode(headings(F.col(text)) if titles is None else titles).alias("h"))
    marks = heads.select(file, F.col("h.pos").alias("at"), F.lit(0).alias("kind"), F.col("h.title").alias("title"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("piece"))
    pieces = chunked(docs, file, text, size, overlap)
    rows = marks.unionByName(pieces.select(file, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("title"), "ord", "piece"))
    last = F.last("title", ignorenulls=True).over(W.partitionBy(file).orderBy("at", "kind", "ord").rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("title", last).filter("kind = 1")
    name = F.col(file).cast("string")
    label = F.when(F.col("title").isNull(), F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(F.lit("["), name, F.lit(" — "), "title", F.lit("]")))
    return found.select(file, "ord", F.col("at").alias("start"), "piece", label.alias("label"))


def stored_and_embedded(chunks: DataFrame, file: str) -> DataFrame:
    """Adds ``text`` and ``embed_text``: a code chunk keeps its label in the text, others only in what is embedded."""
    both = F.concat_ws("\n", "label", "piece")
    code = F.lower(F.col(file).cast("string")).endswith(".py")
    return chunks.select("*", F.when(code, both).otherwise(F.col("piece")).alias("text"), both.alias("embed_text"))
