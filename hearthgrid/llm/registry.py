"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, html_text, importance, language_id, lexical_search, minhash, packing, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, url_filters

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_html_extraction": html_text.op10_html_extraction,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_minhash_near_dedup": minhash.op12_minhash_near_dedup,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLES = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op7_secret_scan": secret_scan.OP7_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op12_minhash_near_dedup": minhash.OP12_SQL,
    "op13_importance_resampling": importance.OP13_SQL,
}
