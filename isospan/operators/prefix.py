"""Sums in the order of a value, and joins by a value, without one task for all rows.

An unpartitioned window sorts everything in one task, and a value that very many
rows share is one window partition or join key. Here rows are first counted by
distinct value; approximate quantiles cut these into ranges, a range is a window
partition, and the totals of the ranges before it are added. Frequent values,
of which there can only be a few, meet their rows by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

RANGES = 256
FREQUENT = 1000  # a value of over 1/FREQUENT of all rows is frequent
WINDOW_ROWS = 1_000_000  # most rows of a group that is one window partition


def number(c: str):
    """A column as double, NaN being missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def window_fits(df: DataFrame, keys: list[str]) -> bool:
    """Whether no group of df has over WINDOW_ROWS rows: one aggregate, run here."""
    if df.isStreaming:
        return False
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (n or 0) <= WINDOW_ROWS


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df hasn't."""
    out = []
    for stem in stems:
        while stem in df.columns or stem in out:
            stem += "_"
        out.append(stem)
    return out


def ranged(df: DataFrame, col: str, ranges: int = RANGES) -> DataFrame:
    """df with _range, growing with col; null col is in range 0."""
    cuts = df.agg(F.percentile_approx(F.col(col), [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    halves = [1 << i for i in range((ranges - 1).bit_length() - 1, -1, -1)]
    # binary search for how many cuts lie below the value
    step = lambda at, h: at + F.when(F.get("_cuts", at + h - 1) < F.col(col), h).otherwise(F.lit(0))
    own = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step)
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", own).drop("_cuts")


def _same(pairs):
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def sums_below(values: DataFrame, by: list[str], col: str, sums: list[str]) -> DataFrame:
    """values with below_<s> for each s: its sum over rows of equal `by` and smaller col.

    values has one row for each by and col.
    """
    work = ranged(values, col)
    keys = [*by, "_range"]
    totals = work.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    upto = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most RANGES rows
    upto = upto.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(s).over(upto), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inside = Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    work = work.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    joined = work.join(before, _same([(k, f"_k{i}") for i, k in enumerate(keys)]))
    return joined.select(*values.columns, *[(F.col(f"_b_{s}") + F.col(f"_i_{s}")).alias(f"below_{s}") for s in sums])


def join_values(rows: DataFrame, table: DataFrame, keys: list[str], count: str, add: list[str]) -> DataFrame:
    """rows with the columns `add` of table, which has a row for each value of keys.

    count, a column of table, says how many rows have the value. Frequent values
    are broadcast (at most FREQUENT); their rows take no part in the join by
    shuffle that brings the others theirs. Null keys are values like others.
    """
    total = table.agg(F.sum(count).alias("_total"))
    marked = table.crossJoin(F.broadcast(total)).withColumn("_often", F.col(count) * FREQUENT > F.col("_total"))
    side = lambda often, s: marked.where(F.col("_often") if often else ~F.col("_often")).select(*[F.col(k).alias(f"{s}k{i}") for i, k in enumerate(keys)], F.struct(*add).alias(f"{s}v"))
    work = rows.join(F.broadcast(side(True, "_f")), _same([(k, f"_fk{i}") for i, k in enumerate(keys)]), "left")
    # by the row itself, so that a row read again goes the same way
    salt = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, MapType)]), F.lit(4096))
    away = F.when(F.col("_fv").isNotNull(), 1 + salt).otherwise(F.lit(0))
    work = work.withColumn("_away", away)
    rare = side(False, "_r").withColumn("_raway", F.lit(0).cast("long"))
    work = work.join(rare, _same([(k, f"_rk{i}") for i, k in enumerate(keys)]) & (F.col("_away") == F.col("_raway")), "left")
    both = F.coalesce("_fv", "_rv")
    return work.select(*[F.col(f"`{c}`") for c in rows.columns], *[both[c].alias(c) for c in add])
