"""Extension: stateless operators on streams.

Standardising, translating and locating are stream-static broadcast joins, so
they take a streaming DataFrame as it is. Panel windows do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import standardize_country


def standardize_stream(stream: DataFrame, country_col: str, **options) -> DataFrame:
    """standardize_country on a stream (append mode, no state)."""
    return standardize_country(stream, country_col, **options)


def windowed_totals(stream: DataFrame, time_col: str, value: str, by: str = "iso3c", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Totals by country and time window, with a watermark for late rows."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), by).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
