"""All registered queries and their SQL."""

from __future__ import annotations

from . import area_queries, content_queries, directory_queries, schedule_queries

_TOPICS = [schedule_queries, directory_queries, area_queries, content_queries]

QUERIES = {name: query for topic in _TOPICS for name, query in topic.QUERIES.items()}
ORACLE = {name: sql for topic in _TOPICS for name, sql in topic.ORACLE.items()}
