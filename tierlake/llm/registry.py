"""Queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import (
    op1_best_fit_packing,
    op2_license_scans,
    op3_suffix_array_dedup,
    op4_url_filters,
    op5_quality_rules,
    op6_minhash_near_dedup,
    op7_benchmark_decontamination,
    op8_substring_dedup,
    op9_quality_classifier,
    op10_line_dedup,
)

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing.op1_best_fit_packing,
    "op2_license_scans": op2_license_scans.op2_license_scans,
    "op3_suffix_array_dedup": op3_suffix_array_dedup.op3_suffix_array_dedup,
    "op4_url_filters": op4_url_filters.op4_url_filters,
    "op5_quality_rules": op5_quality_rules.op5_quality_rules,
    "op6_minhash_near_dedup": op6_minhash_near_dedup.op6_minhash_near_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination.op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup.op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier.op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup.op10_line_dedup,
}
ORACLE_SQL = {
    "op2_license_scans": op2_license_scans.ORACLE,
    "op4_url_filters": op4_url_filters.ORACLE,
    "op10_line_dedup": op10_line_dedup.ORACLE,
}
