"""All queries of the library over the given tables."""

from . import event_queries, policy_queries, stream_queries, text_queries

_MODULES = (text_queries, event_queries, policy_queries, stream_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
