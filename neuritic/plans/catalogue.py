"""All of the library's own queries and their SQL, by name."""

from __future__ import annotations

from . import queries, queries_more, queries_runs  # noqa: F401  (the others register more)

QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
