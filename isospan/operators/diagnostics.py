"""Match reports, name repair and dissolved entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import need_columns, one_of
from ..functions.text import jaro_bound, jaro_distance
from ..refdata import historical_aliases, historical_codes
from ..refdata.crosswalk import crosswalk, rows
from ..refdata.historical import ALIASES, ENTITIES, historical_key
from .resolve import resolved, warn_unmatched

SUGGEST_BELOW = 0.35
SUGGEST_EDITS = 3


def known_names(spark) -> DataFrame:
    """(ord, name): current names, then historical entities, code or not."""
    names = [r[2] for r in sorted(rows(spark), key=lambda r: r[2])] + [e[0] for e in ENTITIES]
    return spark.createDataFrame([(i, n) for i, n in enumerate(dict.fromkeys(names))], "ord int, name string")


def nearest_names(misses: DataFrame, names: DataFrame, method: str = "jaro", within: float | None = None) -> DataFrame:
    """(input, suggestion, distance, share) of distinct inputs: the nearest known name.

    names has some hundreds of rows and is broadcast; ties go to the first.
    share is the distance on a scale of 0 to 1. With within, inputs whose nearest
    name has a greater share are left out, and pairs that cannot come as near by
    their lengths and letters are never compared.
    """
    one_of("method", method, ("jaro", "edit"))
    pairs = misses.select("input").where("input is not null and input <> ''").distinct().crossJoin(F.broadcast(names))
    if within is not None:
        longest = F.greatest(F.length("input"), F.length("name"), F.lit(1))
        least = jaro_bound(F.col("input"), F.col("name")) if method == "jaro" else F.abs(F.length("input") - F.length("name")) / longest
        pairs = pairs.where(least <= within + 1e-12)
    d = jaro_distance(F.col("input"), F.col("name")) if method == "jaro" else F.levenshtein("input", "name").cast("double")
    best = pairs.withColumn("d", d).groupBy("input").agg(F.min(F.struct("d", "ord", "name")).alias("b"))
    share = F.col("b.d") if method == "jaro" else F.col("b.d") / F.greatest(F.length("input"), F.length("b.name"), F.lit(1))
    out = best.select("input", F.col("b.name").alias("suggestion"), F.col("b.d").alias("distance"), share.alias("share"))
    return out if within is None else out.where(F.col("share") <= within)


def check_country_match(df: DataFrame, col: str, origin: str = "country.name", custom_match: dict | None = None, suggest: bool = True, method: str = "jaro") -> DataFrame:
    """(input, iso3c, matched, historical, suggestion), a row per input row.

    historical names the dissolved entity that an input spells, whether or not
    it also has a code. Suggestions are worked out for distinct misses only.
    """
    need_columns(df, col)
    spark = df.sparkSession
    got = resolved(df.select(F.col(f"`{col}`").cast("string").alias("input")), "input", "iso3c", origin, custom_match)
    alias = historical_aliases(spark)
    got = got.withColumn("_k", historical_key(F.col("input"))).join(F.broadcast(alias), F.col("_k") == F.col("alias"), "left")
    got = got.select("input", "iso3c", F.col("iso3c").isNotNull().alias("matched"), "historical")
    if not suggest:
        return got.withColumn("suggestion", F.lit(None).cast("string"))
    near = nearest_names(got.where("not matched"), known_names(spark), method, SUGGEST_BELOW if method == "jaro" else None)
    near = near.where(F.col("distance") < SUGGEST_BELOW if method == "jaro" else F.col("distance") <= SUGGEST_EDITS).select(F.col("input").alias("_i"), "suggestion")
    return got.join(near, (F.col("input") == F.col("_i")) & ~F.col("matched"), "left").select("input", "iso3c", "matched", "historical", "suggestion")


def repair_country_names(df: DataFrame, col: str, threshold: float = 0.2, origin: str = "country.name", out: str | None = None, method: str = "jaro") -> tuple[DataFrame, DataFrame]:
    """(df with col repaired, repairs): misses whose nearest name is near enough are replaced.

    repairs (from, to) has a row per replaced row.
    """
    need_columns(df, col)
    out = out or col
    work = resolved(df.withColumn("_in", F.col(f"`{col}`").cast("string")), "_in", "_iso", origin)
    near = nearest_names(work.where("_iso is null").select(F.col("_in").alias("input")), known_names(df.sparkSession), method, threshold)
    near = near.where((F.col("suggestion") != F.col("input"))).select(F.col("input").alias("_i"), F.col("suggestion").alias("_s"))
    done = work.join(near, (F.col("_in") == F.col("_i")) & F.col("_iso").isNull(), "left")
    repairs = done.where("_s is not null").select(F.col("_in").alias("from"), F.col("_s").alias("to"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    at = df.columns.index(out) if out in df.columns else len(kept)
    kept.insert(at, F.coalesce("_s", "_in").alias(out))
    return done.select(*kept), repairs


def dissolve_country(df: DataFrame, col: str, warn: bool = False) -> DataFrame:
    """(input, historical, dissolved, iso3c, country): a row per successor of a
    dissolved entity, one for any other input; input rows keep their number.
    warn runs one job that says how many names are neither."""
    need_columns(df, col)
    spark = df.sparkSession
    names = df.select(F.col(f"`{col}`").cast("string").alias("input"))
    table = historical_aliases(spark).join(historical_codes(spark), "historical").groupBy("alias").agg(F.collect_list(F.struct("historical", "dissolved", "iso3c", "country")).alias("after"))
    coded = resolved(names, "input", "_iso")
    work = coded.withColumn("_k", historical_key(F.col("input"))).join(F.broadcast(table), F.col("_k") == F.col("alias"), "left")
    modern = F.array(F.struct(F.lit(None).cast("string").alias("historical"), F.lit(None).cast("int").alias("dissolved"), F.col("_iso").alias("iso3c"), F.lit(None).cast("string").alias("country")))
    long = work.select("input", F.explode(F.coalesce("after", modern)).alias("s")).select("input", "s.historical", "s.dissolved", "s.iso3c", "s.country")
    name = crosswalk(spark).select(F.col("iso3c").alias("_c"), F.col("country").alias("_name"))
    out = long.join(F.broadcast(name), F.col("iso3c") == F.col("_c"), "left").select("input", "historical", "dissolved", "iso3c", F.coalesce("country", "_name").alias("country"))
    if warn:
        warn_unmatched(out.where("historical is null"), "input")
    return out


__all__ = ["ALIASES", "check_country_match", "dissolve_country", "known_names", "nearest_names", "repair_country_names"]
