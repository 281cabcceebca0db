"""Operators for preparing training corpora: one module each, plus the thin queries that apply them.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` are what the entry point reads.
"""

from __future__ import annotations


def queries() -> dict:
    from lathe.llm import registry

    return registry.QUERIES


def oracle_sql() -> dict:
    from lathe.llm import registry

    return registry.ORACLE_SQL
