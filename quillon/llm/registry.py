"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["quality_crf", "neighbours", "suffix_dedup", "packing", "language_id", "exact_dedup", "simhash_dedup", "secret_scan", "url_filter", "mixing"]


def queries() -> dict:
    """Query name to function of (spark, sf_dir)."""
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that it can express."""
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").ORACLES.items()}
