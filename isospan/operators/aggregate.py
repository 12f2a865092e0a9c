"""Regional roll-ups, inequality and coverage."""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SpineError, SpineWarning, need_columns, one_of
from .panel import numeric_columns
from .prefix import free_names, number, sums_below, window_fits
from .quantiles import exact_median


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by order (an explicit order makes it certain)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    (n,) = free_names(df, "n")
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def latest_value(df: DataFrame, values: list[str], key: str = "iso3c", year: str = "year") -> DataFrame:
    """Per key, each column's last known value."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(~missing(c), F.col(year))).alias(c) for c in values])


def aggregate_regions(df: DataFrame, value: str, by: str | list = "region", fun: str = "sum", weight: str | None = None) -> DataFrame:
    """by and the aggregate, under the value's name, sorted by `by`.

    Nulls and NaN are left out of every aggregate; a sum of none is 0, others null. A
    null weight of a known value makes a weighted mean null. A null group stays.
    Medians of groups too large for one buffer (a count, run here) are found by
    exact_quantiles.
    """
    one_of("fun", fun, ("sum", "mean", "median", "min", "max", "weighted_mean"))
    keys = [by] if isinstance(by, str) else list(by)
    need_columns(df, value, *keys)
    v = number(value)
    if fun == "median" and not window_fits(df, keys):
        return exact_median(df, value, keys).orderBy(*keys)
    if fun == "weighted_mean":
        if weight is None:
            raise SpineError("weighted_mean needs a weight")
        need_columns(df, weight)
        w = number(weight)
        spoiled = F.max(v.isNotNull() & w.isNull())
        out = F.when(~F.coalesce(spoiled, F.lit(False)), F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))))
    else:
        out = {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "median": F.median(v), "min": F.min(v), "max": F.max(v)}[fun]
    return df.groupBy(*keys).agg(out.alias(value)).orderBy(*keys)


def gini(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One row: gini, from sorted prefix sums; null for no rows or a zero mean.

    Rows with a null value or weight are left out; a negative weight is an error.
    """
    need_columns(df, value, weight)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(value).cast("double").alias("x"), w.alias("w")).where("x is not null and w is not null and not isnan(x) and not isnan(w)")
    rows = rows.withColumn("w", _not_negative(F.col("w")))
    per = rows.groupBy("x").agg(F.sum("w").alias("w")).withColumn("s", F.col("w") * F.col("x"))
    sums = sums_below(per, [], "x", ["w", "s"])
    return sums.agg(F.try_divide(F.sum(F.col("w") * (F.col("x") * F.col("below_w") - F.col("below_s"))), F.sum("w") * F.sum("s")).alias("gini"))


def _not_negative(w):
    return F.when(w < 0, F.raise_error(F.lit("weights must not be negative"))).otherwise(w)


def theil(df: DataFrame, value: str, weight: str | None = None, groups: str | None = None, warn: bool = False) -> DataFrame:
    """One row (theil), or with groups the rows total, between and within with shares.

    Values not above 0 are left out (warn runs a job that says how many); a
    negative weight is an error. Two aggregates, one shuffle.
    """
    need_columns(df, value, weight, groups)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(value).cast("double").alias("x"), w.alias("w"), (F.col(groups) if groups else F.lit(0)).alias("g")).where("x > 0 and not isnan(x) and w is not null and not isnan(w) and g is not null").withColumn("w", _not_negative(F.col("w")))
    if warn:
        left_out = df.where(F.col(value).cast("double") <= 0).count()
        if left_out:
            warnings.warn(f"{left_out} values that are not above 0 are left out", SpineWarning, stacklevel=2)
    per = rows.groupBy("g").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("x") * F.ln("x")).alias("sl"))
    whole = per.agg(F.sum("sw").alias("W"), F.sum("sx").alias("X"), F.sum("sl").alias("L"), F.sum(F.col("sx") * F.ln(F.try_divide(F.col("sx"), F.col("sw")))).alias("B"))
    mean = F.ln(F.try_divide(F.col("X"), F.col("W")))
    whole = whole.select((F.try_divide(F.col("L"), F.col("X")) - mean).alias("total"), (F.try_divide(F.col("B"), F.col("X")) - mean).alias("between"))
    if groups is None:
        return whole.select(F.col("total").alias("theil"))
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), e.alias("value")) for n, e in (("total", F.col("total")), ("between", F.col("between")), ("within", F.col("total") - F.col("between")))])).alias("p")
    return whole.select("total", parts).select("p.component", "p.value", F.try_divide(F.col("p.value"), F.col("total")).alias("share"))


class Coverage(NamedTuple):
    """Tables of audit_coverage."""

    unmatched: DataFrame
    na_rates: DataFrame
    by_group: DataFrame


def missing(c):
    return F.col(c).isNull() | F.isnan(F.col(c).try_cast("double"))


def na_rates(df: DataFrame, indicators: list[str]) -> DataFrame:
    """(indicator, n, n_missing, na_rate), one pass over the table."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(missing(c).cast("long")).alias(f"m{i}") for i, c in enumerate(indicators)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("n_missing")) for i, c in enumerate(indicators)])).alias("p")
    return one.select("n", rows).select("p.indicator", "n", "p.n_missing", F.try_divide(F.col("p.n_missing").cast("double"), F.col("n")).alias("na_rate"))


def audit_coverage(df: DataFrame, indicators: list[str] | None = None, by: str = "region", name: str = "country") -> Coverage:
    """Unmatched names, missing rates by indicator, and by group (of the first indicator)."""
    chosen = indicators or numeric_columns(df, ("year", "long", "lat", "group", "order"))
    need_columns(df, *chosen)
    if not chosen:
        raise SpineError("no indicator column to audit")
    left_out = df.where("iso3c is null").select(name).distinct() if name in df.columns and "iso3c" in df.columns else df.sparkSession.createDataFrame([], f"`{name}` string")
    if by in df.columns:
        groups = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_countries"), F.avg(missing(chosen[0]).cast("double")).alias("na_rate")).orderBy(F.desc("na_rate"), by)
    else:
        groups = df.sparkSession.createDataFrame([], f"`{by}` string, n_countries long, na_rate double")
    return Coverage(left_out, na_rates(df, chosen), groups)
