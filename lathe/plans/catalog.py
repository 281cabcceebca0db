"""Queries over the driver's tables by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from lathe.plans import evaluation, fixtures, relational, requirements, texts  # noqa: F401
from lathe.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
