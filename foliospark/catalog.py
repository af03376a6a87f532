"""All queries of the library, collected from the modules that define them."""

from __future__ import annotations

from .plans import knowledge, pages, retrieval
from .plans.retrieval import flagship

__all__ = ["flagship", "oracle_sql", "queries"]

_MODULES = [retrieval, knowledge, pages]


def queries():
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
