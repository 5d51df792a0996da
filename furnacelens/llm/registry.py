"""Queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_packing", "op2_quality", "op3_language", "op4_line_dedup", "op5_arrow_files", "op6_decontamination", "op7_substring_dedup",
    "op8_ngram_jaccard", "op9_syncmers", "op10_token_counts", "op11_divergence", "op12_collocations", "op13_secrets",
)
QUERIES = {}
SQL = {}
for _name in MODULES:
    _module = import_module(f"furnacelens.llm.{_name}")
    QUERIES[_name] = _module.query
    if getattr(_module, "SQL", None):
        SQL[_name] = _module.SQL
