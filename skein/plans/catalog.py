"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("graphs", "overlays", "boards", "planes", "retrieval", "sessions", "exports", "edits", "syntax", "facts")

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    return [import_module(f"skein.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLES
    return out
