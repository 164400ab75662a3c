"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from tessella.llm import decontamination, html_extraction, jaccard_join, lm_scoring, mixing, pii, quality_classifier, quality_rules, suffix_dedup, warc

_MODULES = [quality_classifier, quality_rules, pii, lm_scoring, mixing, decontamination, suffix_dedup, html_extraction, warc, jaccard_join]


def queries():
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in _MODULES for k, q in getattr(m, "ORACLE_SQL", {}).items()}
