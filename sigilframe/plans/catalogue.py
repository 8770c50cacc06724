"""All queries of the reference's operators over the supplied tables, by name, with their SQL oracles."""

from __future__ import annotations

from sigilframe.plans import catalog_queries, feature_queries, io_queries, perception_queries, quality_queries, record_queries

_ALL = feature_queries.QUERIES | catalog_queries.QUERIES | quality_queries.QUERIES | io_queries.QUERIES | record_queries.QUERIES | perception_queries.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
