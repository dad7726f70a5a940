"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from fernglass.llm import q_documentation, q_mixing, q_near_duplicates, q_packing, q_parsing, q_percentiles, q_splitting, q_subjects

_ALL = (q_documentation, q_percentiles, q_near_duplicates, q_splitting, q_parsing, q_packing, q_mixing, q_subjects)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _ALL for k, v in m.ORACLE.items()}
