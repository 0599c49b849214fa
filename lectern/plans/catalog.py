"""All registered queries of the engine: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import check_queries, event_queries, geometry_queries, page_queries, recognition_queries, text_queries

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **text_queries.QUERIES,
    **page_queries.QUERIES,
    **event_queries.QUERIES,
    **geometry_queries.QUERIES,
    **recognition_queries.QUERIES,
    **check_queries.QUERIES,
}
