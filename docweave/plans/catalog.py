"""The queries over the reference's own operators by name, and their SQL."""

from docweave.plans import graph_queries, knowledge_queries, search_queries, source_queries, text_queries

_MODULES = (graph_queries, knowledge_queries, search_queries, source_queries, text_queries)
QUERIES: dict = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
