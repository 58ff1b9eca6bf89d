"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, exact_search, fill_middle, line_dedup, spelling
from lodestone.llm.decontaminate import op13_benchmark_decontamination
from lodestone.llm.embedding_dedup import op8_embedding_near_dedup
from lodestone.llm.encoding import op2_bpe_round_trip
from lodestone.llm.exact_search import op4_exact_top_k
from lodestone.llm.fill_middle import op11_fill_in_middle
from lodestone.llm.line_dedup import op3_line_dedup
from lodestone.llm.packing import op10_best_fit_packing
from lodestone.llm.quality import op1_quality_attention
from lodestone.llm.simhash import op6_simhash_near_dedup
from lodestone.llm.spelling import op12_spelling_variants
from lodestone.llm.suffix_dedup import op5_suffix_array_dedup
from lodestone.llm.token_counts import op7_token_counts
from lodestone.llm.toxicity import op9_toxicity_weak_supervision


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_attention": op1_quality_attention,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_line_dedup": op3_line_dedup,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_toxicity_weak_supervision": op9_toxicity_weak_supervision,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_benchmark_decontamination": op13_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.ORACLE,
        "op4_exact_top_k": exact_search.ORACLE,
        "op11_fill_in_middle": fill_middle.ORACLE,
        "op12_spelling_variants": spelling.ORACLE,
        "op13_benchmark_decontamination": decontaminate.ORACLE,
    }
