"""All queries of the engine and their SQL."""

from __future__ import annotations

from skein.plans import graph_queries, relational_queries, search_queries, source_queries, stream_queries

QUERIES = {**graph_queries.QUERIES, **search_queries.QUERIES, **relational_queries.QUERIES, **source_queries.QUERIES, **stream_queries.QUERIES}
ORACLES = {**graph_queries.ORACLES, **search_queries.ORACLES, **relational_queries.ORACLES, **source_queries.ORACLES, **stream_queries.ORACLES}
