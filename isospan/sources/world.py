"""Country tables and panels assembled from indicators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpineError, one_of
from ..operators.aggregate import keep_first, latest_value
from ..operators.joins import attach_geometry
from ..operators.resolve import with_attributes
from ..refdata.crosswalk import INCOME_LEVELS, crosswalk
from .indicators import fetch_indicators, normalize_indicator

FIRST_YEAR = 1960


def validate_years(years, now: int | None = None) -> list[int]:
    """Whole, sorted, unique years from 1960 to this one."""
    given = [years] if isinstance(years, (int, float)) else list(years)
    now = now or date.today().year
    if not given or any(not isinstance(y, (int, float)) or y != y for y in given):
        raise SpineError("years must be numbers")
    out = sorted({int(round(y)) for y in given})
    if out[0] < FIRST_YEAR or out[-1] > now:
        raise SpineError(f"years must be from {FIRST_YEAR} to {now}")
    return out


def clean_income(c):
    """An income label, or null if it isn't a known level."""
    return F.when(F.trim(c).isin(INCOME_LEVELS), F.trim(c))


def income_rank(c):
    """Order of an income level, from 1."""
    out = F.lit(None).cast("int")
    for i, level in enumerate(INCOME_LEVELS, 1):
        out = F.when(c == level, F.lit(i)).otherwise(out)
    return out


def country_classification(df: DataFrame, classify: tuple = ("continent", "region"), income: DataFrame | None = None) -> DataFrame:
    """df with continent and region of its codes and, from a table (iso3c, income), income."""
    out = with_attributes(df, tuple(c for c in classify if c != "income"))
    if "income" in classify and income is not None:
        one = income.groupBy("iso3c").agg(F.max(clean_income(F.col("income"))).alias("income"))
        out = out.drop("income").join(F.broadcast(one), "iso3c", "left")
    return out


def country_data(spark: SparkSession, root: str | None, year, indicator=None, latest: bool = False, panel: bool = False, classify: tuple = ("continent", "region"), lookback_years: int = 0, cache: str | None = None, income: DataFrame | None = None) -> DataFrame:
    """A table (or with panel, a row per country and year) of indicators.

    latest takes each column's last known value from lookback_years earlier on;
    without an indicator it is the whole spine, for each year of a panel.
    """
    years = validate_years(year)
    spine = crosswalk(spark).select("iso3c", "iso2c", "country")
    names = normalize_indicator(indicator) if indicator else {}
    if not names:
        out = spine.crossJoin(spark.createDataFrame([(y,) for y in years], "year int")) if panel else spine
    else:
        got = fetch_indicators(spark, root, names, years[0] - (lookback_years if latest else 0), years[-1], cache)
        got = got.join(F.broadcast(spine.select("iso3c")), "iso3c", "left_semi")
        if latest and not panel:
            ids = got.groupBy("iso3c").agg(F.max("iso2c").alias("iso2c"), F.max("country").alias("country"))
            out = ids.join(latest_value(got, list(names)), "iso3c")
        elif panel:
            out = got.where(F.col("year").isin(years))
        else:
            out = keep_first(got.where(F.col("year").isin(years)), ["iso3c"], [F.col("year")]).drop("year")
    out = country_classification(out, classify, income)
    lead = [c for c in ("iso3c", "iso2c", "country", "year", "continent", "region", "income") if c in out.columns]
    return out.select(*lead, *[c for c in out.columns if c not in lead])


def world_data(spark: SparkSession, root: str | None, year, indicator=None, geometry: DataFrame | None = None, mode: str = "polygon", projection: str | None = None, recenter: float = 0.0, region=None, **options) -> DataFrame:
    """country_data, and with a frame its geometry LEFT JOIN the data.

    mode polygon gives a row per vertex, sf one per country with its shape as
    well-known binary, none the data alone. A region keeps its countries; a
    projection moves the shapes, recenter is its middle longitude.
    """
    from ..operators.spatial import split_antimeridian
    from ..sinks.export import wkb_frame
    from .geometry import projected, world_geometry

    one_of("geometry", mode, ("polygon", "sf", "none"))
    years = validate_years(year)
    data = country_data(spark, root, years, indicator, panel=len(years) > 1, **options)
    if geometry is None or mode == "none":
        return data
    frame = world_geometry(geometry, region=region)
    if projection:
        shifted = F.pmod(F.col("long") - recenter + 180, F.lit(360.0)) - 180 + recenter if recenter else F.col("long")
        frame = split_antimeridian(frame.withColumn("long", shifted)) if recenter else frame
        frame = projected(frame, projection, recenter)
    if mode == "sf":
        return attach_geometry(data, wkb_frame(frame.select("iso3c", "group", "order", "long", "lat")))
    return attach_geometry(data, frame)
