"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import chat_format, compression_quality, knn, language_id, mixing, packing, quality_rules, ranked_search, simhash, substring_dedup, token_count, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_packing": packing.op2_packing,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_language_id": language_id.op6_language_id,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_simhash": simhash.op8_simhash,
        "op9_token_counts": token_count.op9_token_counts,
        "op10_kdtree_topk": knn.op10_kdtree_topk,
        "op11_whitening": whitening.op11_whitening,
        "op12_compression_quality": compression_quality.op12_compression_quality,
        "op13_ranked_search": ranked_search.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op7_chat_format": chat_format.OP7_SQL,
        "op10_kdtree_topk": knn.OP10_SQL,
        "op13_ranked_search": ranked_search.OP13_SQL,
    }
