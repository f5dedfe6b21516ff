"""Registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("pipeline", "scalar", "intervals_q", "analytics", "families", "scans", "composites")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        part = getattr(import_module(f"{__name__}.{m}"), name)
        if clash := out.keys() & part.keys():
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out |= part
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
