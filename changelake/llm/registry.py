"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import chat_tools, decontaminate, html_extract, langid, license_scan, media_avi, mixing, ngram_join, secret_scan, toxicity

MODULES = [langid, html_extract, chat_tools, decontaminate, mixing, secret_scan, ngram_join, license_scan, media_avi, toxicity]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
