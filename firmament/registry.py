"""Every registered query and its check SQL."""

from __future__ import annotations

import importlib
import pkgutil

from firmament import queries as _pkg
from firmament.queries.kit import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    for m in pkgutil.iter_modules(_pkg.__path__):
        if m.name != "kit":
            importlib.import_module(f"{_pkg.__name__}.{m.name}")
    return dict(QUERIES), dict(ORACLES)
