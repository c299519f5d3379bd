"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    chat_format, collocations, decontaminate, fill_middle, license_scan, line_dedup, ngram_join, packing, quality_rules, sharding, substring_dedup, suffix_dedup, url_filter,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_chat_formatting": chat_format.op2_chat_formatting,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_sharding": sharding.op4_sharding,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_suffix_array_dedup": suffix_dedup.op6_suffix_array_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_phrase_collocation_mining": collocations.op11_phrase_collocation_mining,
    "op12_license_scans": license_scan.op12_license_scans,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_chat_formatting": chat_format.ORACLE,
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op11_phrase_collocation_mining": collocations.ORACLE,
    "op12_license_scans": license_scan.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
