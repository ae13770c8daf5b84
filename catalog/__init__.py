"""Runnable queries over the given tables, each next to the SQL that states the expected rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

SECTIONS = ("bars", "series", "contagion", "evaluation", "storage", "scalars", "market", "models", "streams")


class Catalog(NamedTuple):
    queries: dict[str, Callable]
    sql: dict[str, str]


def load() -> Catalog:
    from catalog import registry

    for section in SECTIONS:
        importlib.import_module(f"catalog.{section}")
    return Catalog(registry.QUERIES, registry.SQL)
