"""The numbered queries and their SQL."""

from __future__ import annotations

from tessera.llm import (
    curve_packing, html_extraction, license_scans, mixing, packing, quality_rules, simhash, substring_dedup, token_alignment, token_counts, topk_search, url_filters,
    whitening,
)


def queries() -> dict:
    return {
        "op1_html_extraction": html_extraction.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_top_k_search": topk_search.query,
        "op4_best_fit_packing": packing.query,
        "op5_simhash": simhash.query,
        "op6_license_scans": license_scans.query,
        "op7_source_mixing": mixing.query,
        "op8_quality_rules": quality_rules.query,
        "op9_token_counts": token_counts.query,
        "op10_url_filters": url_filters.query,
        "op11_embedding_whitening": whitening.query,
        "op12_token_alignment": token_alignment.query,
        "op13_curve_packing": curve_packing.query,
    }


def oracle_sql() -> dict:
    return {"op3_top_k_search": topk_search.sql(), "op10_url_filters": url_filters.sql()}
