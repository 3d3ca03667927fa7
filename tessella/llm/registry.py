"""The queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontam, jaccard, lexical, lm, mixing, nearest, quality, substrings, tokens, toxicity, urls, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substrings.op1_substring_dedup,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_decontaminate": decontam.op3_decontaminate,
        "op4_quality": quality.op4_quality,
        "op5_lm_scores": lm.op5_lm_scores,
        "op6_token_output": tokens.op6_token_output,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_vector_dedup": vectors.op8_vector_dedup,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_url_filter": urls.op10_url_filter,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_nearest": nearest.op12_nearest,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substrings.SQL,
        "op2_jaccard": jaccard.SQL,
        "op8_vector_dedup": vectors.SQL,
        "op3_decontaminate": decontam.SQL,
        "op10_url_filter": urls.SQL,
        "op11_lexical_search": lexical.SQL,
        "op12_nearest": nearest.SQL,
        "op13_conversation_repair": conversations.SQL,
    }
