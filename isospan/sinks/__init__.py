"""Sinks: Parquet, DuckDB, Arrow, temporary views and chart query text."""

from .export import as_source, wkb_frame
from .query_text import ChartQuery, world_query

__all__ = ["ChartQuery", "as_source", "wkb_frame", "world_query"]
