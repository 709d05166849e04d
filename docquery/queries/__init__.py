"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import more, ranking, relations, texts

MODULES = (texts, ranking, relations, more)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
flagship = ranking.flagship
