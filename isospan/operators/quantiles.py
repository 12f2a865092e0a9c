"""Exact quantiles of many groups at once, however large a group is.

A group's values are never brought together. Sketches bracket the rank that is
looked for, counts say how many values lie below and in the bracket, and this is
done again inside it until few enough are left to be put in order.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SpineError, need_columns
from ..shared import cut
from .prefix import number

IN_BRACKET = 500_000  # most distinct values of a bracket that are put in order
GRID = 500
ACCURACY = 10_000
BROADCAST_BRACKETS = 100_000


def _same(keys):
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond &= F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    return cond


def exact_quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, in_bracket: int | None = None) -> DataFrame:
    """(keys, prob, quantile): interpolated between the two nearest ranks (type 7).

    Nulls and NaN are left out; groups without values have no rows. Runs a few
    aggregates here: one where no group has more than in_bracket values, else two more for
    each narrowing, by a factor of some 100.
    """
    keys = list(keys or [])
    need_columns(df, value, *keys)
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise SpineError("probabilities must be between 0 and 1")
    most = in_bracket or IN_BRACKET
    rows = df.select(*[F.col(f"`{k}`") for k in keys], number(value).alias("_x")).where("_x is not null")
    own = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    held = [f"_k{i}" for i in range(len(keys))]
    sizes = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).where("n > 0")
    at = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), ((F.col("n") - 1) * float(p)).alias("h")) for p in sorted(set(probs))])).alias("_t")
    targets = cut(sizes.select(*held, "n", "lo", "hi", at).select(*held, "_t.prob", "_t.h", F.col("n").alias("m"), F.lit(0).cast("long").alias("below"), "lo", "hi"))
    few = targets.count() <= BROADCAST_BRACKETS

    def met(brackets, inside=True):
        small = F.broadcast(brackets) if few else brackets
        got = rows.join(small, _same(keys)) if keys else rows.crossJoin(small)
        return got.where("_x >= lo and _x <= hi") if inside else got

    spots = [i / GRID for i in range(GRID + 1)]
    while True:
        wide = targets.where((F.col("m") > most) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        sketch = met(wide).groupBy(*held, "prob").agg(F.percentile_approx("_x", spots, ACCURACY).alias("g"))
        match = [*held, "prob"]
        known = wide.join(sketch.withColumnsRenamed({c: f"s{c}" for c in match}), [wide[c].eqNullSafe(F.col(f"s{c}")) for c in match]).select(*wide.columns, "g")
        place = lambda r: (F.col("h") - F.col("below") + r) / F.col("m") * GRID
        low, high = F.greatest(F.floor(place(0)) - 2, F.lit(0)).cast("int"), F.least(F.ceil(place(1)) + 3, F.lit(GRID)).cast("int")
        new = known.withColumns({"nlo": F.when(low == 0, F.col("lo")).otherwise(F.get("g", low)), "nhi": F.when(high == GRID, F.col("hi")).otherwise(F.get("g", high))}).drop("g")
        new = cut(new)
        count = met(new).groupBy(*held, "prob").agg(F.sum((F.col("_x") < F.col("nlo")).cast("long")).alias("less"), F.sum(((F.col("_x") >= F.col("nlo")) & (F.col("_x") <= F.col("nhi"))).cast("long")).alias("in"))
        count = count.withColumnsRenamed({c: f"s{c}" for c in match})
        narrow = new.join(count, [new[c].eqNullSafe(F.col(f"s{c}")) for c in match]).select(*held, "prob", "h", F.col("in").alias("m"), (F.col("below") + F.col("less")).alias("below"), F.col("nlo").alias("lo"), F.col("nhi").alias("hi"))
        before = wide.agg(F.sum("m")).first()[0]
        narrow = cut(narrow)
        targets = cut(targets.where(~((F.col("m") > most) & (F.col("lo") < F.col("hi")))).unionByName(narrow))
        if narrow.agg(F.sum("m")).first()[0] >= before:  # equal values fill the brackets; their counts are few
            break
    ranked = met(targets).groupBy(*held, "prob", "h", "below", "_x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*held, "prob").orderBy("_x"))
    ranked = ranked.withColumn("upto", upto)
    pick = lambda r: F.min(F.when(F.col("upto") > r, F.col("_x")))
    got = ranked.groupBy(*held, "prob").agg(F.first("h").alias("h"), pick(F.floor("h")).alias("a"), pick(F.ceil("h")).alias("b"))
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    return got.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "prob", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("quantile"))


def exact_median(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value): medians, by exact_quantiles; null for groups without values."""
    got = exact_quantiles(df, value, [0.5], keys).drop("prob")
    held = got.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("quantile").alias("_q"))
    return df.select(*[F.col(f"`{k}`") for k in keys]).distinct().join(held, _same(keys), "left").select(*[F.col(f"`{k}`") for k in keys], F.col("_q").alias(value))


