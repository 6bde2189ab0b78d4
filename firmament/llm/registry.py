"""Queries of this package and their check SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    package = __name__.rpartition(".")[0]
    for m in pkgutil.iter_modules(importlib.import_module(package).__path__):
        importlib.import_module(f"{package}.{m.name}")
    return dict(QUERIES), dict(ORACLES)
