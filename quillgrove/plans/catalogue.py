"""All queries of the library by name, with the DuckDB SQL that checks them."""

from __future__ import annotations

from quillgrove.plans import conversation_queries, document_queries, dynamics_queries, event_queries, identity_queries, recall_queries, record_queries, relation_queries, reply_queries, signal_queries, state_queries, text_queries, vector_queries
from quillgrove.plans.registry import Query

_MODULES = (recall_queries, dynamics_queries, event_queries, conversation_queries, vector_queries, document_queries, record_queries, signal_queries, identity_queries, text_queries, relation_queries, state_queries, reply_queries)

QUERIES: dict[str, Query] = {name: f for m in _MODULES for name, f in m.query.queries.items()}
SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.query.sql.items()}
