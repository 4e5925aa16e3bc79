"""The queries of this subpackage and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseq.llm import (
    bpe_chunks,
    byte_bpe,
    chat_format,
    exact_dedup,
    fingerprints,
    language_id,
    ngram_join,
    packing,
    periodic_runs,
    repeats,
    secret_scan,
    turn_repair,
    url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_group_prefix_join": ngram_join.op1_group_prefix_join,
        "op2_chunk_reuse": bpe_chunks.op2_chunk_reuse,
        "op3_path_templates": url_filter.op3_path_templates,
        "op4_tier_packing": packing.op4_tier_packing,
        "op5_secret_automaton": secret_scan.op5_secret_automaton,
        "op6_repeated_strings": repeats.op6_repeated_strings,
        "op7_string_kernel": language_id.op7_string_kernel,
        "op8_digest_index": exact_dedup.op8_digest_index,
        "op9_one_permutation": fingerprints.op9_one_permutation,
        "op10_perspective_rotation": chat_format.op10_perspective_rotation,
        "op11_overlapping_chunks": byte_bpe.op11_overlapping_chunks,
        "op12_checkpointed_repair": turn_repair.op12_checkpointed_repair,
        "op13_frequency_splitting": periodic_runs.op13_frequency_splitting,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_digest_index": exact_dedup.SQL, "op10_perspective_rotation": chat_format.SQL}
