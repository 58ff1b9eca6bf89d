"""A training-data pipeline over ``documents``: five stages, each of which works on what its predecessor kept.

Every stage but the last returns the columns of ``documents``; ``n_chars`` follows the text.
Stages run one after the other on tables written to the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, packing, similar_texts, suffix_dedup, toxicity
from lodestone.llm.tables import documents, stored, table


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with the columns of ``before``, and n_chars, where there is one, of its own texts."""
    kinds = dict(before.dtypes)
    return after.select(*(F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in before.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later repeated runs of lines go (a line of some length is a run)."""
    return _counted(docs, line_dedup.remove_repeated_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near-duplicates stays."""
    return similar_texts.one_of_each_group(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: strings of 100 bytes that start earlier are cut out."""
    return _counted(docs, suffix_dedup.cut_repeats(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: what is left is packed into sequences; one row per piece."""
    return packing.pack(packing.cut(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("best_fit_packing", pack_sequences),
]

#: Trained weights and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
