"""The queries of the library and their SQL."""

from __future__ import annotations

from .plans import core, more, recording, study  # noqa: F401  each adds its queries to those of core

QUERIES = core.QUERIES
ORACLE_SQL = core.ORACLE_SQL
