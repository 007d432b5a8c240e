"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import chat_format, decontaminate, hard_negatives, html_extract, jaccard_join, language_id, license_scan, line_dedup, nearest, packing, phrase_mining, quality_rules, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": substring_dedup.op1_suffix_array_dedup,
    "op2_chat_formatting": chat_format.op2_chat_formatting,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_phrase_collocations": phrase_mining.op11_phrase_collocations,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_nearest_neighbours": nearest.op13_nearest_neighbours,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat_format.SQL,
    "op4_license_scan": license_scan.SQL,
    "op6_benchmark_decontamination": decontaminate.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_phrase_collocations": phrase_mining.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
