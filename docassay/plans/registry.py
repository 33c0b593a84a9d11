"""All registered queries of the document-verification operators, with their SQL."""

from __future__ import annotations

from . import extension_queries, lifecycle_queries, prominent_queries, quality_queries, text_queries, word_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (text_queries, lifecycle_queries, word_queries, prominent_queries, quality_queries, extension_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
