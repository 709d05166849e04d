"""Every query of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontam, jaccard_join, language_id, license_scan, matroska, mixing, secret_scan, suffix_dedup, toxicity

MODULES = (chat_format, toxicity, mixing, suffix_dedup, jaccard_join, license_scan, secret_scan, matroska, language_id, decontam)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
