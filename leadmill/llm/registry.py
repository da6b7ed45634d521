"""Names of the corpus queries and the SQL that some of them are held against."""

from __future__ import annotations

from leadmill.llm import oracle, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
ORACLE_SQL: dict[str, str] = oracle.SQL
