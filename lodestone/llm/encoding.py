"""Operator 2: BPE encoding and decoding with the tokenization automaton of :mod:`bpe`."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.tables import documents, map_rows


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids binary)``: ids of each whole text as little-endian 32-bit integers.

    Null and empty texts have no ids; repeated rows and keys stay as they are; other
    columns of ``df`` are not read.  Texts of any length are encoded whole, about a
    million characters at a time.  An empty table gives an empty table.
    """
    automaton = bpe.shipped(df.sparkSession, path)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, texts = bpe.encoder_of(automaton), batch.column(1).to_pylist()
        for lo, hi in bpe.in_slices(texts):
            ids = pa.array(encoder.encode(texts[lo:hi]), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["key", "ids"])

    out = map_rows(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {dict(df.dtypes)[key]}, ids binary")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)``: the labels of the arcs that the ids name, joined by spaces; null ids give the empty text."""
    automaton = bpe.shipped(df.sparkSession, path)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder_of(automaton)
        got = [encoder.decode(x or b"") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["key", "text"])

    out = map_rows(df.select(F.col(key).alias("key"), F.col(ids).alias("ids")), work, f"key {dict(df.dtypes)[key]}, text string")
    return out.withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass, keeping digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    automaton = bpe.shipped(df.sparkSession, path)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, texts = bpe.encoder_of(automaton), batch.column(1).to_pylist()
        for lo, hi in bpe.in_slices(texts):
            ids = encoder.encode(texts[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_rows(df.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
