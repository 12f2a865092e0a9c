"""Resolution of names and codes to ISO 3166 alpha-3, and code translation.

Lookup tables have some hundreds of rows, whatever the data: they are broadcast
and the data is never shuffled. Tiers: exact override, normalised spelling,
pattern, spelling without its form of state, tokens where asked for, null.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpineError, UnsupportedScheme, need_columns
from ..functions.text import trimmed
from ..refdata import country_overrides, dictionary
from ..refdata.crosswalk import CONTINENTS, PATTERNS, crosswalk, localized_names, normal_column, rows, scheme_column, short_column
from ..refdata.groups import GROUPS, members
from .tokens import code_by_tokens, token_index

_count = itertools.count()


def resolved(df: DataFrame, col: str, out: str = "iso3c", origin: str = "country.name", custom_match: dict | None = None, tokens: bool = False) -> DataFrame:
    """df with column out, the alpha-3 code of col (replacing a column out).

    origin country.name resolves spellings; iso3c only upper-cases and trims,
    without asking whether the code exists; other schemes are looked up. An
    exact match of the raw value in custom_match (default: the built-in
    overrides) wins under the first two. With tokens, names that are still
    unknown are looked up by their tokens; that takes about a millisecond each,
    so many rows are best resolved by distinct names.
    """
    need_columns(df, col)
    spark, n = df.sparkSession, next(_count)
    matches = country_overrides() if custom_match is None else custom_match
    raw = F.col(f"`{col}`").cast("string")
    if origin in ("country.name", "iso3c"):
        over = spark.createDataFrame(list(matches.items()) or [(None, None)], f"_k{n} string, _o{n} string")
        work = df.withColumn(f"_raw{n}", raw)
        work = work.join(F.broadcast(over), F.col(f"_raw{n}") == F.col(f"_k{n}"), "left")
        if origin == "iso3c":
            code = F.coalesce(f"_o{n}", F.upper(trimmed(F.col(f"_raw{n}"))))
        else:
            names = spark.createDataFrame(list(dictionary(spark).items()), f"_a{n} string, _d{n} string")
            work = work.withColumn(f"_n{n}", normal_column(F.col(f"_raw{n}"))).join(F.broadcast(names), F.col(f"_n{n}") == F.col(f"_a{n}"), "left")
            low = F.lower(F.col(f"_raw{n}"))
            hits = F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(c)) for c, p in PATTERNS.items()])))
            by_pattern = F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))  # more than one code: ambiguous
            work = work.withColumn(f"_s{n}", short_column(F.col(f"_n{n}"))).join(F.broadcast(names.toDF(f"_b{n}", f"_e{n}")), F.col(f"_s{n}") == F.col(f"_b{n}"), "left")
            code = F.coalesce(f"_o{n}", f"_d{n}", F.when(F.col(f"_d{n}").isNull() & raw.isNotNull(), by_pattern), F.when(F.size(hits) == 0, F.col(f"_e{n}")))
            if tokens:
                work = work.crossJoin(F.broadcast(token_index(spark)))
                code = F.coalesce(code, F.when((F.size(hits) == 0) & raw.isNotNull(), code_by_tokens(raw, F.col(f"_n{n}"))))
    else:
        key = scheme_column(origin)
        table = crosswalk(spark).select(F.col(key).cast("string").alias(f"_k{n}"), F.col("iso3c").alias(f"_o{n}")).where(f"_k{n} is not null").groupBy(f"_k{n}").agg(F.max(f"_o{n}").alias(f"_o{n}"), F.countDistinct(f"_o{n}").alias(f"_c{n}")).where(f"_c{n} = 1")
        work = df.join(F.broadcast(table), F.upper(raw) == F.upper(F.col(f"_k{n}")), "left")
        code = F.col(f"_o{n}")
    kept = [c for c in df.columns if c != out]
    return work.withColumn(f"_out{n}", code).select(*[F.col(f"`{c}`") for c in kept], F.col(f"_out{n}").alias(out))


def with_attributes(df: DataFrame, add: list[str] | tuple, code: str = "iso3c") -> DataFrame:
    """df with crosswalk columns of its code, appended; they replace columns of their names."""
    if not add:
        return df
    spark, n = df.sparkSession, next(_count)
    table = crosswalk(spark).select(F.col("iso3c").alias(f"_c{n}"), *[F.col(scheme_column(a)).alias(f"_x{n}_{i}") for i, a in enumerate(add)])
    joined = df.join(F.broadcast(table), F.col(f"`{code}`") == F.col(f"_c{n}"), "left")
    kept = [c for c in df.columns if c not in add]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_x{n}_{i}").alias(a) for i, a in enumerate(add)])


def standardize_country(df: DataFrame, country_col: str, origin: str = "country.name", add: tuple = ("iso2c", "continent", "region"), custom_match: dict | None = None, warn: bool = False) -> DataFrame:
    """df with iso3c and the attributes in add, at the end, replacing columns of
    those names, the input column included if it has one. warn runs one job over
    the distinct values and lists those without a code."""
    out = resolved(df, country_col, "iso3c", origin, custom_match)
    if warn:
        warn_unmatched(out, country_col)
    return with_attributes(out, tuple(a for a in add if a != "iso3c"))


def warn_unmatched(df: DataFrame, col: str, most: int = 20) -> None:
    import warnings

    from ..errors import SpineWarning

    if col not in df.columns:
        return
    missed = df.where(F.col("iso3c").isNull() & F.col(f"`{col}`").isNotNull()).select(F.col(f"`{col}`").cast("string").alias("v")).distinct()
    n, some = missed.count(), [r[0] for r in missed.orderBy("v").limit(most).collect()]
    if n:
        warnings.warn(f"no country code for: {', '.join(some)}" + (f" and {n - len(some)} more" if n > len(some) else ""), SpineWarning, stacklevel=3)


def convert_country(df: DataFrame, col: str, to: str = "iso3c", origin: str = "country.name", out: str | None = None, custom_match: dict | None = None, warn: bool = False) -> DataFrame:
    """df with column out (default: to), col translated to scheme `to`.

    `to` is a crosswalk scheme or name_<language> for a localized name. XKX has
    no flag unless it was reached by name.
    """
    out = out or to
    n = next(_count)
    work = resolved(df.withColumn(f"_in{n}", F.col(f"`{col}`")), f"_in{n}", f"_iso{n}", origin, custom_match)
    if to == "iso3c":
        done = work.withColumn(f"_v{n}", F.col(f"_iso{n}"))
    elif to.startswith("name_"):
        table = localized_names(df.sparkSession, to[5:]).toDF(f"_c{n}", f"_v{n}")
        done = work.join(F.broadcast(table), F.col(f"_iso{n}") == F.col(f"_c{n}"), "left")
    else:
        scheme = scheme_column(to)
        value = F.when(F.col("iso3c") == "XKX", F.lit(None)).otherwise(F.col(scheme)) if scheme == "flag" and origin == "iso3c" else F.col(scheme)
        table = crosswalk(df.sparkSession).select(F.col("iso3c").alias(f"_c{n}"), value.alias(f"_v{n}"))
        done = work.join(F.broadcast(table), F.col(f"_iso{n}") == F.col(f"_c{n}"), "left")
    kept = [c for c in df.columns if c != out]
    done = done.select(*[F.col(f"`{c}`") for c in kept], F.col(f"_v{n}").alias(out))
    if warn:
        warn_unmatched(done.withColumn("iso3c", F.col(f"`{out}`")), col)
    return done


def convert_values(spark, values: list, to: str = "iso3c", origin: str = "country.name", **options) -> list:
    """convert_country of a short list of values, in order, on the driver."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in convert_country(df, "v", to, origin, "out", **options).orderBy("i").select("out").collect()]


def in_group(df: DataFrame, col: str, group: str, origin: str = "country.name", out: str = "in_group") -> DataFrame:
    """df with boolean out: whether col's country is in a group; never null."""
    codes, n = members(group), next(_count)
    work = resolved(df.withColumn(f"_in{n}", F.col(f"`{col}`")), f"_in{n}", f"_iso{n}", origin)
    kept = [c for c in df.columns if c != out]
    return work.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"_iso{n}").isin(codes), F.lit(False)).alias(out))


def region_codes(spark, region) -> list[str] | None:
    """Codes meant by a region: a continent, a group, codes, or country names.

    None for no region and for a bounding box of four numbers.
    """
    if region is None or (isinstance(region, (list, tuple)) and len(region) == 4 and all(isinstance(v, (int, float)) for v in region)):
        return None
    wanted = [region] if isinstance(region, str) else list(region)
    if len(wanted) == 1 and wanted[0] in CONTINENTS:
        return [r[0] for r in rows(spark) if r[3] == wanted[0]]
    if len(wanted) == 1 and wanted[0] in GROUPS:
        return members(wanted[0])
    if all(isinstance(v, str) and len(v) == 3 and v.upper() == v for v in wanted):
        return wanted
    codes = [c for c in convert_values(spark, wanted) if c]
    if not codes:
        raise SpineError(f"no country in region {region!r}")
    return codes


def region_predicate(spark, region, lon: str = "long", lat: str = "lat", code: str = "iso3c") -> Column:
    """Rows of a region: by code, or by coordinates within (west, south, east, north)."""
    codes = region_codes(spark, region)
    if region is None:
        return F.lit(True)
    if codes is None:
        west, south, east, north = region
        return F.col(lon).between(west, east) & F.col(lat).between(south, north)
    return F.col(code).isin(codes)


CANDIDATES = ("country", "country_name", "countryname", "nation", "iso3c", "iso3", "iso2c", "iso2", "iso", "location", "entity")


def detect_country_col(df: DataFrame) -> str:
    """The country column: by name, else the first string column of which more
    than half of the values resolve (one aggregate over all of them)."""
    for c in df.columns:
        if c.lower() in CANDIDATES:
            return c
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if strings:
        work, shares = df.select(*[F.col(f"`{c}`").alias(f"s{i}") for i, c in enumerate(strings)]), []
        for i in range(len(strings)):
            work = resolved(work, f"s{i}", f"r{i}")
            shares.append(F.avg(F.col(f"r{i}").isNotNull().cast("double")))
        for c, share in zip(strings, work.agg(*shares).first()):
            if share is not None and share > 0.5:
                return c
    raise SpineError("no column of countries found; name one")


__all__ = ["UnsupportedScheme", "convert_country", "convert_values", "detect_country_col", "in_group", "region_codes", "region_predicate", "resolved", "standardize_country", "with_attributes"]
