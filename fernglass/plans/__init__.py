"""Registered queries: every module here has QUERIES and ORACLE."""

MODULES = ["code_search", "code_graph", "extraction", "index_upkeep", "telemetry_reports", "ranking_eval", "graph_orphans", "streams"]
