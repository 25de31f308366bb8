"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from .plans import base, evaluation, features, models, predictions  # noqa: F401

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
