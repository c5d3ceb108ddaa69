"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import classify, corpus, entities, layout, more, pages, parts, records

MODULES = (entities, classify, corpus, layout, records, pages, more, parts)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
