"""Registered queries: the engine's operators over the test tables, with their SQL."""

from . import alert_queries, analytics_queries, ingest_queries, read_queries, stream_queries, upkeep_queries

QUERIES_MODULES = [read_queries, analytics_queries, alert_queries, ingest_queries, stream_queries,
                   upkeep_queries]
