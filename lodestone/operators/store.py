"""A chunk store as a table: append, delete, counts.  ``chunks`` has ``chunk_id``, ``file`` and what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_documents(uploads: DataFrame, chunks: DataFrame, file: str = "file") -> DataFrame:
    """Uploads whose file is not in the store."""
    return uploads.join(chunks.select(file).distinct(), file, "left_anti")


def append(chunks: DataFrame, more: DataFrame) -> DataFrame:
    """Both; vectors of different models or dimensions are refused."""
    if "dim" in chunks.columns:
        kinds = chunks.select("model", "dim").unionByName(more.select("model", "dim")).distinct().limit(2).collect()
        if len(kinds) > 1:
            raise ValueError(f"one store, one model: {[tuple(k) for k in kinds]}")
    return chunks.unionByName(more)


def remove_document(chunks: DataFrame, name: str, file: str = "file") -> DataFrame:
    return chunks.filter(~F.col(file).eqNullSafe(name))


def document_names(chunks: DataFrame, file: str = "file", key: str = "chunk_id") -> DataFrame:
    """Files in the order of their first chunk: ``file, first``."""
    return chunks.groupBy(file).agg(F.min(key).alias("first"))


def chunk_counts(chunks: DataFrame, file: str = "file") -> DataFrame:
    return chunks.groupBy(file).agg(F.count("*").alias("n_chunks"))


def is_empty(chunks: DataFrame) -> bool:
    return chunks.isEmpty()
