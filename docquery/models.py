"""Pluggable models: an embedder, a reranker, a text generator. Offline defaults are deterministic; others are registered.

A model is a function of Columns that gives a Column (a pandas UDF, or built-in functions).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text, vectors


@dataclass(frozen=True)
class Model:
    id: str
    call: Callable[..., Column]
    fallback: bool = False


DIM, RERANKER_ID = vectors.DIM, "fallback:lexical:v1"
_MODELS: dict[str, Model] = {}


def register_embedder(id: str, call: Callable[[Column], Column]) -> None:
    _MODELS["embedder"] = Model(id, call)


def register_reranker(id: str, call: Callable[[Column, Column], Column]) -> None:
    _MODELS["reranker"] = Model(id, call)


def register_llm(id: str, call: Callable[[Column], Column]) -> None:
    """call: prompt -> answer, null where it has none."""
    _MODELS["llm"] = Model(id, call)


def reset(kind: str | None = None) -> None:
    for k in [kind] if kind else list(_MODELS):
        _MODELS.pop(k, None)


def embedder(native: bool = False) -> Model:
    if native:
        return _MODELS.get("embedder") or Model(f"fallback:hashing-xx:{DIM}:v1", vectors.native_embedding, True)
    return _MODELS.get("embedder") or Model(f"fallback:hashing:{DIM}:v1", vectors.hashing_embedder(DIM), True)


def reranker() -> Model:
    return _MODELS.get("reranker") or Model(RERANKER_ID, vectors.lexical_score, True)


def llm() -> Model | None:
    return _MODELS.get("llm")


def generate(prompt: Column, default: Column) -> Column:
    """The generator's answer, else the default."""
    m = llm()
    return default if m is None else F.coalesce(text.or_else(text.strip(m.call(prompt)), F.lit(None)), default)


def info() -> dict:
    e, r, g = embedder(), reranker(), llm()
    return {"embedding_model": e.id, "embedding_dim": DIM, "embedding_fallback": e.fallback, "reranker_model": r.id, "reranker_fallback": r.fallback, "llm": g.id if g else None}


def validate(production: bool) -> None:
    """In production, fallbacks are refused."""
    bad = [m.id for m in (embedder(), reranker()) if m.fallback]
    if production and bad:
        raise ValueError(f"fallback models in production: {', '.join(bad)}")
