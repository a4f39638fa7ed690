"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_token_ids",
    "op2_simhash",
    "op3_token_counts",
    "op4_decontaminate",
    "op5_quality",
    "op6_html",
    "op7_neighbours",
    "op8_byte_bpe",
    "op9_url_filter",
    "op10_pii",
    "op11_negatives",
    "op12_phrases",
    "op13_ngram_join",
)


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
