"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

#: Module and query of each operator.
OPERATORS = {
    "op1_substring_dedup": "op1_substring_dedup",
    "op2_near_dedup": "op2_near_dedup",
    "op3_token_counts": "op3_token_counts",
    "op4_url_filter": "op4_url_filter",
    "op5_quality_classifier": "op5_quality_classifier",
    "op6_html_text": "op6_html_text",
    "op7_source_mix": "op7_source_mix",
    "op8_fingerprints": "op8_fingerprints",
    "op9_quality_rules": "op9_quality_rules",
    "op10_packing": "op10_packing",
    "op11_license_scan": "op11_license_scan",
    "op12_source_audit": "op12_source_audit",
    "op13_spelling_variants": "op13_spelling_variants",
}


def queries() -> dict:
    return {q: getattr(import_module(f"docloom.llm.{m}"), q) for q, m in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {q: m.SQL for q, m in ((q, import_module(f"docloom.llm.{m}")) for q, m in OPERATORS.items()) if m.SQL}
