"""Queries of this subpackage by name, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from tidelog.llm import best_fit_packing, decontamination, license_scan, line_dedup, lm_scoring, near_duplicates, personal_data, quality_rules, suffix_dedup, web_archive

_MODULES = (near_duplicates, lm_scoring, line_dedup, quality_rules, suffix_dedup, web_archive, license_scan, personal_data, decontamination, best_fit_packing)

QUERIES: dict[str, Callable] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
