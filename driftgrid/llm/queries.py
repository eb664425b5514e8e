"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format, collocations, decontamination, license_scan, near_dedup, packing, periodic_runs, quality_model, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_packing": packing.op2_packing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_collocations": collocations.op11_collocations,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_toxicity": toxicity.op13_toxicity,
    "rule_ablation": quality_rules.rule_ablation,
    "packed_mixture": packing.packed_mixture,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op10_chat_format": chat_format.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_periodic_runs": periodic_runs.ORACLE_SQL,
    "rule_ablation": quality_rules.ABLATION_SQL,
}
