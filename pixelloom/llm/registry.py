"""Registered corpus queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, filter_audit, language, language_model, line_rules, packing, pieces, simhash, suffix_dedup, turns, url_filter, warc, weak_labels


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_revisit_resolution": warc.op1_revisit_resolution,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_line_frequency": line_rules.op3_line_frequency,
        "op4_simhash": simhash.op4_simhash,
        "op5_language_id": language.op5_language_id,
        "op6_mixture_packing": packing.op6_mixture_packing,
        "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
        "op8_temporal_url_filter": url_filter.op8_temporal_url_filter,
        "op9_weak_label_quality": weak_labels.op9_weak_label_quality,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "op11_language_model": language_model.op11_language_model,
        "op12_conversation_repair": turns.op12_conversation_repair,
        "op13_filter_interaction_audit": filter_audit.op13_filter_interaction_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_revisit_resolution": warc.OP1_SQL,
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op3_line_frequency": line_rules.OP3_SQL,
        "op7_suffix_array_dedup": suffix_dedup.OP7_SQL,
        "op8_temporal_url_filter": url_filter.OP8_SQL,
        "op12_conversation_repair": turns.OP12_SQL,
        "op13_filter_interaction_audit": filter_audit.OP13_SQL,
    }
