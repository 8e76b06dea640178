"""Registered queries (Spark) and their SQL oracles, merged from the area modules."""

from __future__ import annotations

from importlib import import_module

_AREAS = ("profiling", "splits", "prep", "evaluation", "models")


def _load():
    queries, oracles = {}, {}
    for name in _AREAS:
        mod = import_module(f"{__name__}.{name}")
        queries.update(mod.QUERIES)
        oracles.update(mod.ORACLES)
    return queries, oracles


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
