"""Registered queries: every operator run over whole test tables, each with the SQL that gives the same result."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("replication", "analytics", "runs", "streams")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= getattr(import_module(f"{__name__}.{name}"), what)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")
