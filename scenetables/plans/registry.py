"""Registry of the scene queries on the driver tables, and of the SQL that checks them."""

from __future__ import annotations

from scenetables.plans import file_queries, geometry_queries, record_queries, scene_queries, task_queries, track_queries

_PARTS = (track_queries, scene_queries, geometry_queries, record_queries, task_queries, file_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
