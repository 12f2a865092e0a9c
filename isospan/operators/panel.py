"""Panel operators: windows over a country's rows in year order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpineError, need_columns, one_of
from .prefix import free_names, join_values, number, sums_below, window_fits

ISO, YEAR = "iso3c", "year"


def _by_year(desc: bool = False):
    return Window.partitionBy(ISO).orderBy(F.col(YEAR).asc_nulls_last())


def _whole():
    return _by_year().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _need_panel(df, *names):
    need_columns(df, ISO, YEAR, *names)


def lag_by_country(df: DataFrame, value: str, n: int = 1, suffix: str | None = None, by: str = "row") -> DataFrame:
    """Adds the value n rows earlier (by="row"), or n years earlier (by="year")."""
    _need_panel(df, value)
    if n < 1:
        raise SpineError("n must be 1 or more")
    name = f"{value}{suffix if suffix is not None else '_lag' + (str(n) if n > 1 else '')}"
    if one_of("by", by, ("row", "year")) == "row":
        return df.withColumn(name, F.lag(value, n).over(_by_year()))
    at = Window.partitionBy(ISO).orderBy(F.col(YEAR).cast("long")).rangeBetween(-n, -n)
    return df.withColumn(name, F.first(value).over(at))


def diff_by_country(df: DataFrame, value: str, n: int = 1, suffix: str | None = None) -> DataFrame:
    """Adds the change since n rows earlier."""
    _need_panel(df, value)
    if n < 1:
        raise SpineError("n must be 1 or more")
    name = f"{value}{suffix if suffix is not None else '_diff' + (str(n) if n > 1 else '')}"
    return df.withColumn(name, F.col(value) - F.lag(value, n).over(_by_year()))


def growth_rate(df: DataFrame, value: str, kind: str = "yoy", suffix: str = "_growth") -> DataFrame:
    """Adds growth since the previous row (yoy), or per year since the first known value (cagr)."""
    _need_panel(df, value)
    one_of("type", kind, ("yoy", "cagr"))
    v = number(value)
    if kind == "yoy":
        return df.withColumn(f"{value}{suffix}", F.try_divide(v, F.lag(v).over(_by_year())) - 1)
    known = F.when(v.isNotNull(), F.struct(F.col(YEAR).alias("y"), v.alias("v")))
    first = F.first(known, ignorenulls=True).over(_whole())
    span, base = F.col(YEAR) - first["y"], first["v"]
    ratio = F.try_divide(v, base)
    rate = F.when((span > 0) & (base > 0) & (ratio >= 0), F.pow(ratio, F.try_divide(F.lit(1.0), span)) - 1)
    return df.withColumn(f"{value}{suffix}", rate)


def index_to(df: DataFrame, value: str, base_year: int, to: float = 100.0, suffix: str = "_index") -> DataFrame:
    """Adds the value as a share of its base year's, times `to`; null without a base or with 0."""
    _need_panel(df, value)
    base = F.max(F.when(F.col(YEAR) == base_year, number(value))).over(Window.partitionBy(ISO))
    return df.withColumn(f"{value}{suffix}", F.try_divide(number(value), F.nullif(base, F.lit(0.0))) * F.lit(float(to)))


def share_of_world(df: DataFrame, value: str, suffix: str = "_share") -> DataFrame:
    """Adds the value's share of the sum over its year, or over all rows without a year.

    Years are window partitions where the rows of each fit in one (a count, run
    here); else totals are joined, those of frequent years by broadcast.
    """
    need_columns(df, value)
    v = number(value)
    if YEAR in df.columns:
        if window_fits(df, [YEAR]):
            return df.withColumn(f"{value}{suffix}", F.try_divide(v, F.sum(v).over(Window.partitionBy(YEAR))))
        total, n = free_names(df, "total", "n")
        per = df.groupBy(YEAR).agg(F.sum(v).alias(total), F.count(F.lit(1)).alias(n))
        return join_values(df, per, [YEAR], n, [total]).withColumn(f"{value}{suffix}", F.try_divide(v, F.col(total))).drop(total)
    total = df.agg(F.sum(v).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(f"{value}{suffix}", F.try_divide(v, F.col("_total"))).drop("_total")


def rank_countries(df: DataFrame, value: str, within: str | list | None = None, desc: bool = True) -> DataFrame:
    """Adds rank (competition rank), percentile (always ascending) and z_score.

    Null and NaN values have none of them and aren't counted. Groups are window
    partitions where the rows of each fit in one (a count, run here); else ranks
    come from counts of distinct values (see prefix), so that no task sorts all
    rows of a group.
    """
    keys = [] if within is None else [within] if isinstance(within, str) else list(within)
    need_columns(df, value, *keys)
    x, n, every, mean, sd, low = free_names(df, "x", "n", "every", "mean", "sd", "below_n")
    made = ["rank", "percentile", "z_score"]
    rows = df.drop(*[c for c in made if c != value and c not in keys]).withColumn(x, number(value))
    if window_fits(rows, keys):
        part = Window.partitionBy(*(keys or [F.lit(0)]))
        ordered = lambda c: F.when(F.col(x).isNotNull(), F.rank().over(part.orderBy(c)))
        up, others = ordered(F.col(x).asc_nulls_last()), F.count(x).over(part) - 1
        place = ordered(F.col(x).desc_nulls_last()) if desc else up
        z = F.try_divide(F.col(x) - F.avg(x).over(part), F.stddev_samp(x).over(part))
        return rows.withColumns({"rank": place.cast("int"), "percentile": F.try_divide((up - 1).cast("double"), others), "z_score": z}).drop(x)
    known = rows.where(F.col(x).isNotNull())
    per = sums_below(known.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n")), keys, x, ["n"]).withColumnsRenamed({"n": n, "below_n": low})
    whole = known.groupBy(*keys).agg(F.count(x).alias(every), F.avg(x).alias(mean), F.stddev_samp(x).alias(sd))
    if keys:
        per = join_values(per, whole, keys, every, [every, mean, sd])
    else:
        per = per.crossJoin(F.broadcast(whole))
    place = F.col(every) - F.col(low) - F.col(n) + 1 if desc else F.col(low) + 1
    per = per.withColumns({"rank": place.cast("int"), "percentile": F.try_divide(F.col(low).cast("double"), F.col(every) - 1), "z_score": F.try_divide(F.col(x) - F.col(mean), F.col(sd))})
    return join_values(rows, per, [*keys, x], n, made).drop(x)


def top_k(df: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """Rows ranked k or better."""
    return df.where(F.col(rank) <= k)


def numeric_columns(df: DataFrame, leave: tuple = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in leave]


def complete_years(df: DataFrame, years: list[int] | None = None, value: str | list | None = None, method: str = "none") -> DataFrame:
    """A row for every country and year (default: first to last year of the table).

    Rows of other years stay. Columns that are neither keys nor values are
    static and filled down, then up; with value named, other numeric columns
    are static too. Gaps of values are then left (none), filled with the last
    known value in year order (locf) or interpolated between known years
    (linear; nothing beyond the ends). NaN is missing.
    """
    _need_panel(df)
    one_of("method", method, ("none", "locf", "linear"))
    values = numeric_columns(df, (YEAR,)) if value is None else [value] if isinstance(value, str) else list(value)
    need_columns(df, *values)
    kind = df.schema[YEAR].dataType
    if years is None:
        span = df.agg(F.min(YEAR).alias("a"), F.max(YEAR).alias("b")).where("a is not null")
        axis = span.select(F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias(YEAR))
    else:
        axis = df.sparkSession.createDataFrame([(int(y),) for y in sorted(set(years))], f"{YEAR} int")
    grid = df.select(ISO).distinct().crossJoin(F.broadcast(axis.withColumn(YEAR, F.col(YEAR).cast(kind))))
    rest = [c for c in df.columns if c not in (ISO, YEAR)]
    own = df.withColumnsRenamed({ISO: "_i", YEAR: "_y"})
    full = grid.join(own, F.col(ISO).eqNullSafe(F.col("_i")) & F.col(YEAR).eqNullSafe(F.col("_y")), "full")
    real = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    known = lambda c: F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in real else F.col(f"`{c}`")
    out = full.select(F.coalesce(ISO, "_i").alias(ISO), F.coalesce(YEAR, "_y").alias(YEAR), *map(known, rest))
    down = _by_year().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = _by_year().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fill = {c: F.coalesce(F.last(c, ignorenulls=True).over(down), F.first(c, ignorenulls=True).over(up)) for c in rest if c not in values}
    if method == "locf":
        fill |= {c: F.last(c, ignorenulls=True).over(down) for c in values}
    if method == "linear":
        for c in values:
            pair = F.when(F.col(c).isNotNull(), F.struct(F.col(YEAR).cast("double").alias("y"), F.col(c).cast("double").alias("v")))
            a, b = F.last(pair, ignorenulls=True).over(down), F.first(pair, ignorenulls=True).over(up)
            fill[c] = F.coalesce(F.col(c).cast("double"), a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col(YEAR) - a["y"], b["y"] - a["y"]))
    filled = out.withColumns({f"_f{i}": e for i, e in enumerate(fill.values())})
    at = {c: F.col(f"_f{i}").alias(c) for i, c in enumerate(fill)}
    return filled.select(*[at.get(c, F.col(f"`{c}`")) for c in df.columns])


def per_capita(df: DataFrame, value: str, pop: str | None = None, population: DataFrame | None = None, suffix: str = "_per_capita") -> DataFrame:
    """Adds value / pop; without a pop column, population (iso3c[, year], population) is joined."""
    need_columns(df, value)
    work, name = df, pop
    if pop is None:
        if population is None:
            raise SpineError("name the population column or give a population table")
        keys = [ISO, YEAR] if YEAR in df.columns and YEAR in population.columns else [ISO]
        *held, name = free_names(df, *[f"key_{k}" for k in keys], "people")
        table = population.groupBy(*[F.col(k).alias(h) for k, h in zip(keys, held)]).agg(F.first("population", ignorenulls=True).alias(name))
        cond = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, held)]
        work = df.join(table, cond[0] if len(cond) == 1 else cond[0] & cond[1], "left")
    need_columns(work, name)
    out = work.withColumn(f"{value}{suffix}", F.try_divide(number(value), number(name)))
    return out.select(*dict.fromkeys([*df.columns, f"{value}{suffix}"]))
