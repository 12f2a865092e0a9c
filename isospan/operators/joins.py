"""Joins on the country spine: null keys match each other, as in the data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpineError, need_columns, one_of
from .resolve import detect_country_col, resolved, standardize_country


def spine_join(x: DataFrame, y: DataFrame, how: str = "left", suffix: tuple = (".x", ".y"), na_matches: str = "na", key: str = "iso3c") -> DataFrame:
    """Equi-join on key; clashing other columns get the suffixes, key comes as in x.

    Null-safe equality is still an equi-join: a hash or sort-merge join, or a
    broadcast one where a side is small.
    """
    one_of("type", how, ("left", "inner", "full"))
    one_of("na_matches", na_matches, ("na", "never"))
    need_columns(x, key)
    need_columns(y, key)
    clash = (set(x.columns) & set(y.columns)) - {key}
    left = x.select(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(x.columns)])
    right = y.select(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(y.columns)])
    lk, rk = F.col(f"l{x.columns.index(key)}"), F.col(f"r{y.columns.index(key)}")
    joined = left.join(right, lk.eqNullSafe(rk) if na_matches == "na" else lk == rk, how)
    names = lambda df, side, s: [F.col(f"{side}{i}").alias(c + s if c in clash else c) for i, c in enumerate(df.columns) if c != key]
    left_cols = [F.coalesce(lk, rk).alias(key) if c == key else F.col(f"l{i}").alias(c + suffix[0] if c in clash else c) for i, c in enumerate(x.columns)]
    return joined.select(*left_cols, *names(y, "r", suffix[1]))


def country_join(x: DataFrame, y: DataFrame, by_x: str, by_y: str | None = None, origin_x: str = "country.name", origin_y: str | None = None, how: str = "left", suffix: tuple = (".x", ".y"), custom_match: dict | None = None, na_matches: str = "na") -> DataFrame:
    """Joins two tables whose country columns are spelled differently."""
    left = resolved(x, by_x, "iso3c", origin_x, custom_match)
    right = resolved(y, by_y or by_x, "iso3c", origin_y or origin_x, custom_match)
    return spine_join(left, right, how, suffix, na_matches)


def country_join_all(tables: list[DataFrame], by: str | list, origin: str | list = "country.name", how: str = "full", suffix: tuple = (".x", ".y")) -> DataFrame:
    """Joins any number of tables from the left; by and origin are one or one per table."""
    if len(tables) < 2:
        raise SpineError("needs two tables or more")
    bys = [by] * len(tables) if isinstance(by, str) else list(by)
    origins = [origin] * len(tables) if isinstance(origin, str) else list(origin)
    if len(bys) != len(tables) or len(origins) != len(tables):
        raise SpineError("by and origin must have one entry, or one for each table")
    coded = [resolved(t, b, "iso3c", o) for t, b, o in zip(tables, bys, origins)]
    return reduce(lambda a, b: spine_join(a, b, how, suffix), coded)


def attach_geometry(data: DataFrame, geometry: DataFrame, by: str = "iso3c") -> DataFrame:
    """All rows of geometry with data's columns: geometry LEFT JOIN data.

    Geometry columns that data also has yield to data's.
    """
    need_columns(data, by)
    kept = [c for c in geometry.columns if c == by or c not in data.columns]
    return spine_join(geometry.select(*kept), data, "left", key=by)


def join_world(data: DataFrame, geometry: DataFrame | None = None, country_col: str | None = None, origin: str = "country.name", add: tuple = ("iso2c", "continent", "region"), warn: bool = False) -> DataFrame:
    """Detects the country column, standardises it and attaches geometry, if any."""
    col = country_col or detect_country_col(data)
    out = standardize_country(data, col, origin, add, warn=warn)
    return out if geometry is None else attach_geometry(out, geometry)
