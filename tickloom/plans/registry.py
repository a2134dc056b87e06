"""All registered queries and their SQL, gathered from the catalog modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

CATALOGS = ["bars", "series", "labels", "stats", "news", "posttrade", "ranking", "portfolio", "streams"]


def _modules():
    return [importlib.import_module(f"tickloom.plans.catalog_{name}") for name in CATALOGS]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in _modules():
        clash = out.keys() & m.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out.update(m.SQL)
    return out
