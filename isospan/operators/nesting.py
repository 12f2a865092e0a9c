"""Which rings of a country are outlines and which are holes, and whose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_ring
from .spatial import rings

CELL = 10.0


def signed_area(ring: Column) -> Column:
    """Planar area of a ring (lon, lat), positive where it turns left."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]), F.lit(0.0), lambda a, c: a + c) / 2


def inner_point(ring: Column) -> Column:
    """(x, y) inside a ring: on a line near its middle height, between the first two crossings."""
    ys = F.transform(ring, lambda p: p["lat"])
    y = F.array_min(ys) * 0.499983 + F.array_max(ys) * 0.500017  # off vertices at the very middle
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    at = F.zip_with(ring, after, lambda p, q: F.when((p["lat"] > y) != (q["lat"] > y), p["lon"] + (y - p["lat"]) / (q["lat"] - p["lat"]) * (q["lon"] - p["lon"])))
    xs = F.array_sort(F.array_compact(at))
    return F.struct(((F.get(xs, 0) + F.get(xs, 1)) / 2).alias("x"), y.alias("y"))


def nested_rings(frame: DataFrame, cell: float = CELL) -> DataFrame:
    """(iso3c, group, ring, area, depth, parent): the containment forest of each country's rings.

    depth counts the rings around a ring: at odd depths rings are holes, of the
    ring right around them, their parent; at even ones outlines. Rings may touch
    but don't cross. A ring meets those whose bounding box has its inner point's
    cell, an equi-join; rings without an inside are outlines of their own.
    """
    all_rings = rings(frame).withColumn("area", signed_area(F.col("ring"))).withColumn("at", inner_point(F.col("ring")))
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    axis = lambda c: F.explode(F.sequence(F.floor(F.array_min(c) / cell).cast("int"), F.floor(F.array_max(c) / cell).cast("int")))
    outer = all_rings.where("area <> 0").select("iso3c", F.col("group").alias("parent"), F.col("ring").alias("_around"), F.abs("area").alias("_size"), axis(lon).alias("cx"), lat.alias("_lat"))
    outer = outer.withColumn("cy", axis(F.col("_lat"))).drop("_lat")
    inner = all_rings.where("at.x is not null").select("iso3c", "group", "at", F.abs("area").alias("_own"), F.floor(F.col("at.x") / cell).cast("int").alias("cx"), F.floor(F.col("at.y") / cell).cast("int").alias("cy"))
    met = inner.join(outer, ["iso3c", "cx", "cy"]).where((F.col("group") != F.col("parent")) & (F.col("_size") > F.col("_own")))
    around = met.where(in_ring(F.col("at.x"), F.col("at.y"), F.col("_around")))
    found = around.groupBy("iso3c", "group").agg(F.count(F.lit(1)).alias("depth"), F.min_by("parent", F.struct("_size", "parent")).alias("parent"))
    return all_rings.join(found, ["iso3c", "group"], "left").select("iso3c", "group", "ring", "area", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), "parent")


def polygons(frame: DataFrame) -> DataFrame:
    """(iso3c, parts): each country's outlines in group order, each an array of
    rings: itself turning left, then its holes turning right."""
    nested = nested_rings(frame)
    hole = F.col("depth") % 2 == 1
    turned = F.when((F.col("area") < 0) != hole, F.reverse("ring")).otherwise(F.col("ring"))
    of = F.when(hole, F.col("parent")).otherwise(F.col("group"))
    one = nested.groupBy("iso3c", of.alias("group")).agg(F.sort_array(F.collect_list(F.struct(hole.alias("hole"), F.col("group").alias("g"), turned.alias("ring")))).alias("r"))
    one = one.withColumn("rings", F.transform("r", lambda s: s["ring"]))
    return one.groupBy("iso3c").agg(F.transform(F.sort_array(F.collect_list(F.struct("group", "rings"))), lambda s: s["rings"]).alias("parts"))
