"""The registered queries of the interval engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES: tuple[str, ...] = ("ranking", "talk", "energy", "publishing", "streams", "documents", "layers")


def _loaded():
    return [import_module(f"tidemark.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable]:
    return {k: v for m in _loaded() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _loaded() for k, v in m.ORACLE.items()}
