"""All queries of the library beside those of leadmill.llm, and the SQL that they are held against."""

from __future__ import annotations

from leadmill.plans import assignment_queries, attempt_queries, merge_queries, more_queries, payload_queries, review_queries, search_queries, variant_queries

QUERIES = {**more_queries.QUERIES, **assignment_queries.QUERIES, **search_queries.QUERIES, **variant_queries.QUERIES, **merge_queries.QUERIES, **attempt_queries.QUERIES, **payload_queries.QUERIES, **review_queries.QUERIES}
ORACLE_SQL = {**more_queries.ORACLE_SQL, **assignment_queries.ORACLE_SQL, **search_queries.ORACLE_SQL, **variant_queries.ORACLE_SQL, **merge_queries.ORACLE_SQL, **attempt_queries.ORACLE_SQL, **payload_queries.ORACLE_SQL, **review_queries.ORACLE_SQL}
