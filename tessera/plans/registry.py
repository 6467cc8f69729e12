"""All queries by name, and their SQL."""

from tessera.plans import index_queries, memory_queries, sql_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from tessera.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
