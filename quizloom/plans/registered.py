"""Loads every plan module, which registers its queries."""

from __future__ import annotations

import importlib
import pkgutil

from .catalog import ORACLE, QUERIES

# Integer widths the SQL engine chooses differently (its sums are 128 bits wide).
_LEVELS = {f"n_{v}": "BIGINT" for v in ("easy", "medium", "hard", "remember", "understand", "apply", "analyze")}
_WIDTHS = {
    "landing_cards": {v: "BIGINT" for v in ("easy", "medium", "hard")},
    "combined_header": {"questions_per_set": "BIGINT"},
    "vector_top_k": {"rank": "INTEGER"},
    "vector_top_k_filtered": {"rank": "INTEGER"},
    "metadata_filter": {"rank": "INTEGER"},
    "allocation_invariants": {"total": "BIGINT", "chapters_in_bounds": "BIGINT"},
    "allocation_report": {"quota": "BIGINT"},
    "quota_acceptance": {"place": "INTEGER"},
    "set_metrics": {**_LEVELS, "chapters_in_range": "BIGINT"},
    "level_distributions": _LEVELS,
    "difficulty_balance": {"chapters_in_range": "BIGINT"},
    "answer_position_skew": {f"n_{p}": "BIGINT" for p in "abcd"},
    "jaccard_pairs": {"shared": "INTEGER"},
    "front_matter_removed": {"n": "INTEGER"},
    "book_sections_by_title": {"start": "INTEGER"},
    "heading_sections": {"section_no": "INTEGER"},
    "tagged_sections": {"section_no": "INTEGER"},
    "chunk_metadata": {"char_count": "INTEGER"},
    "bigram_counts": {"n": "INTEGER"},
    "set_operations_on_tags": {"shared": "INTEGER", "joined": "INTEGER"},
    "parsed_responses": {"parsed": "INTEGER"},
}
_HELPERS = {"catalog", "items", "registered"}


def _load() -> None:
    package = importlib.import_module(__package__)
    for found in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        if found not in _HELPERS:
            importlib.import_module(f"{__package__}.{found}")


def queries():
    _load()
    return dict(QUERIES)


def _sized(name: str, sql: str) -> str:
    widths = _WIDTHS.get(name)
    if not widths:
        return sql
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in widths.items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def oracle_sql():
    _load()
    return {name: _sized(name, sql) for name, sql in ORACLE.items()}
