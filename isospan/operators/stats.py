"""Correlation, convergence and spatial autocorrelation."""

from __future__ import annotations

import math
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SpineError, need_columns, one_of
from ..functions.stats import t_two_sided
from .aggregate import keep_first
from .panel import numeric_columns
from .prefix import join_values, number, sums_below

STOP = ("year", "long", "lat", "lon", "group", "order", "row", "col")


def finite(c):
    v = F.col(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def _coefficient(x, y):
    sd = F.stddev_samp(x) * F.stddev_samp(y)
    return F.try_divide(F.covar_samp(x, y), sd)


def correlate_indicators(df: DataFrame, columns: list[str] | None = None, method: str = "pearson", min_n: int = 3) -> DataFrame:
    """(var_x, var_y, r, n) of every pair, by falling |r|, nulls last.

    A pair takes the rows where both are finite; r is null below min_n rows or
    for a constant column. Pearson is one aggregate over the table.
    """
    one_of("method", method, ("pearson", "spearman"))
    chosen = columns or numeric_columns(df, STOP)
    need_columns(df, *chosen)
    wrong = [c for c in chosen if c not in numeric_columns(df)]
    if wrong:
        raise SpineError(f"not numeric: {', '.join(wrong)}")
    if len(chosen) < 2:
        raise SpineError("needs two numeric columns or more")
    pairs = list(combinations(chosen, 2))
    if method == "pearson":
        cols = []
        for i, (a, b) in enumerate(pairs):
            both = finite(a) & finite(b)
            x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
            cols += [F.count(x).alias(f"n{i}"), _coefficient(x, y).alias(f"r{i}")]
        one = df.agg(*cols)
        rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("p")
        out = one.select(rows).select("p.*")
    else:
        long = df.select(F.explode(F.array(*[F.when(finite(a) & finite(b), F.struct(F.lit(i).alias("ord"), F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))) for i, (a, b) in enumerate(pairs)])).alias("p")).where("p is not null").select("p.*")

        tables = []
        for c in ("x", "y"):
            per = sums_below(long.groupBy("ord", c).agg(F.count(F.lit(1)).alias("n")), ["ord"], c, ["n"])
            tables.append((c, per.withColumn(f"r{c}", F.col("below_n") + (F.col("n") + 1) / 2)))
        for c, per in tables:
            long = join_values(long, per, ["ord", c], "n", [f"r{c}"])
        got = long.groupBy("ord").agg(_coefficient(F.col("rx"), F.col("ry")).alias("r"), F.count(F.lit(1)).alias("n"))
        every = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "ord int, var_x string, var_y string")
        out = every.join(got, "ord", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    out = out.withColumn("r", F.when(F.col("n") >= min_n, F.col("r")))
    return out.orderBy(F.abs("r").desc_nulls_last(), "ord").select("var_x", "var_y", "r", "n")


def _endpoints(df: DataFrame, value: str) -> DataFrame:
    known = df.select("iso3c", "year", number(value).alias("v")).where("v > 0 and year is not null")
    ends = known.groupBy("iso3c").agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min_by("v", "year").alias("v0"), F.max_by("v", "year").alias("v1")).where("y1 > y0")
    return ends.select((F.col("y1") - F.col("y0")).cast("double").alias("span"), F.ln("v0").alias("x"), ((F.ln("v1") - F.ln("v0")) / (F.col("y1") - F.col("y0"))).alias("g"))


class Convergence(NamedTuple):
    """A fitted convergence model."""

    beta: float
    intercept: float
    std_error: float | None
    t_value: float | None
    p_value: float | None
    r_squared: float | None
    n: int
    speed: float | None
    half_life: float | None


def beta_terms(df: DataFrame, value: str) -> DataFrame:
    """One row of regression terms of growth on initial log level."""
    need_columns(df, "iso3c", "year", value)
    return _endpoints(df, value).agg(
        F.regr_slope("g", "x").alias("beta"), F.regr_intercept("g", "x").alias("intercept"), F.regr_r2("g", "x").alias("r_squared"),
        F.regr_sxx("g", "x").alias("sxx"), F.regr_syy("g", "x").alias("syy"), F.regr_sxy("g", "x").alias("sxy"), F.regr_count("g", "x").alias("n"), F.avg("span").alias("span"),
    )


def fit_beta(df: DataFrame, value: str) -> Convergence:
    """Regresses average log growth on initial log level; collects one row."""
    r = beta_terms(df, value).first()
    n = int(r["n"])
    if n < 3:
        raise SpineError(f"needs 3 countries or more with two years each, not {n}")
    if r["beta"] is None:
        raise SpineError("initial values are all equal")
    rest = max(0.0, r["syy"] - r["sxy"] ** 2 / r["sxx"])
    se = math.sqrt(rest / (n - 2) / r["sxx"])
    t = r["beta"] / se if se else None
    inside = 1 + r["beta"] * r["span"]
    speed = -math.log(inside) / r["span"] if r["beta"] < 0 < inside else None
    return Convergence(r["beta"], r["intercept"], se, t, t_two_sided(t, n - 2) if t is not None else None, r["r_squared"], n, speed, math.log(2) / speed if speed else None)


def beta_convergence(df: DataFrame, value: str) -> DataFrame:
    """fit_beta as a one-row table."""
    schema = "beta double, intercept double, std_error double, t_value double, p_value double, r_squared double, n long, speed double, half_life double"
    return df.sparkSession.createDataFrame([tuple(fit_beta(df, value))], schema)


def sigma_convergence(df: DataFrame, value: str, measure: str = "sd_log") -> DataFrame:
    """(year, n, sigma): dispersion of the positive values by year."""
    one_of("measure", measure, ("sd_log", "cv"))
    need_columns(df, "year", value)
    known = df.select("year", number(value).alias("v")).where("v > 0")
    s = F.stddev_samp(F.ln("v")) if measure == "sd_log" else F.try_divide(F.stddev_samp("v"), F.avg("v"))
    return known.groupBy("year").agg(F.count(F.lit(1)).alias("n"), s.alias("sigma")).orderBy("year")


def morans_i(df: DataFrame, value: str, edges: DataFrame, n_perm: int = 999, seed: int = 1, order: list | None = None) -> DataFrame:
    """One row: morans_i, expected, p_value, n, n_links.

    edges: (iso3c_a, iso3c_b), unordered. The first row of each country counts
    (by order, default all columns); then non-finite values drop out. Weights
    are row-standardised over neighbours in the data. Permutations reshuffle
    the values over countries, all in one plan; p is null for n_perm 0.
    """
    need_columns(df, "iso3c", value)
    one = keep_first(df, ["iso3c"], order or [F.col(f"`{c}`") for c in df.columns])
    known = one.where("iso3c is not null").where(finite(value)).select("iso3c", F.col(value).cast("double").alias("v"))
    both = edges.select(F.col("iso3c_a").alias("a"), F.col("iso3c_b").alias("b")).where("a <> b")
    both = both.union(both.select("b", "a")).distinct()
    both = both.join(known.select(F.col("iso3c").alias("a")), "a", "left_semi").join(known.select(F.col("iso3c").alias("b")), "b", "left_semi").select("a", "b")
    nodes = known.join(both.select(F.col("a").alias("iso3c")).distinct(), "iso3c", "left_semi")
    nodes = nodes.withColumn("i", F.row_number().over(Window.orderBy("iso3c")))  # a row per country
    draws = df.sparkSession.range(0, n_perm + 1).withColumnRenamed("id", "perm")
    dealt = nodes.select("iso3c", "i").crossJoin(draws).withColumn("j", F.when(F.col("perm") == 0, F.col("i")).otherwise(F.row_number().over(Window.partitionBy("perm").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("perm"), "iso3c"))))))
    values = dealt.join(nodes.select(F.col("i").alias("j"), "v"), "j").select("perm", "iso3c", "v")
    mean = F.avg("v").over(Window.partitionBy("perm"))
    z = values.select("perm", "iso3c", (F.col("v") - mean).alias("z"))
    near = both.join(z.select("perm", F.col("iso3c").alias("b"), F.col("z").alias("zb")), "b").groupBy("perm", F.col("a").alias("iso3c")).agg(F.avg("zb").alias("zn"))
    per = z.join(near, ["perm", "iso3c"]).groupBy("perm").agg(F.try_divide(F.sum(F.col("z") * F.col("zn")), F.sum(F.col("z") * F.col("z"))).alias("I"), F.count(F.lit(1)).alias("n"))
    seen = F.max(F.when(F.col("perm") == 0, F.col("I")))
    out = per.agg(seen.alias("morans_i"), F.max("n").alias("n"), F.collect_list(F.when(F.col("perm") > 0, F.col("I"))).alias("_all"))
    p = F.when(F.lit(n_perm) > 0, (1 + F.size(F.filter("_all", lambda x: x >= F.col("morans_i")))) / F.lit(n_perm + 1.0))
    links = both.agg((F.count(F.lit(1)) / 2).cast("long").alias("n_links"))
    guard = F.when(F.coalesce("n", F.lit(0)) < 3, F.raise_error(F.lit("needs 3 countries with neighbours or more"))).otherwise(F.col("morans_i"))
    return out.crossJoin(F.broadcast(links)).select(guard.alias("morans_i"), (-1.0 / (F.col("n") - 1)).alias("expected"), p.alias("p_value"), "n", "n_links")
