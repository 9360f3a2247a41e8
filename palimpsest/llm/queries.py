"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from palimpsest.llm import embedding_dedup, html_extract, license_scan, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, token_counts

_MODULES = (embedding_dedup, html_extract, license_scan, quality_rules, line_dedup, quality_classifier, simhash, packing, token_counts, mixing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
