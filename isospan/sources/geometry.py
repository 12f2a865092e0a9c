"""Polygon frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import one_of
from ..functions.geo import project
from ..operators.resolve import region_predicate, resolved
from ..operators.spatial import clip_box, graticule, interior_points, outline_edges, polygon_centroids


def polygon_frame(spark: SparkSession, path: str, name_col: str = "region", region=None, clip: bool = False, custom_match: dict | None = None) -> DataFrame:
    """A frame (long, lat, group, order, ..) from Parquet, with iso3c from its names
    where it has none or an invalid one; a region keeps its rows, or with clip
    cuts rings to a bounding box."""
    df = spark.read.parquet(path)
    if name_col in df.columns:
        df = resolved(df, name_col, "_named", custom_match=custom_match)
        own = F.when(F.col("iso3c").isin("-99", "-099", ""), F.lit(None)).otherwise(F.col("iso3c")) if "iso3c" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("iso3c", F.coalesce(own, "_named")).drop("_named")
    if clip and region is not None and not isinstance(region, str) and len(region) == 4:
        return clip_box(df, *region)
    return df.where(region_predicate(spark, region))


def square_grid(spark: SparkSession, codes: list[str], columns: int = 5, size: float = 10.0) -> DataFrame:
    """A synthetic frame: one square per code on a grid, neighbours sharing corners."""
    rows = []
    for i, code in enumerate(codes):
        x, y = (i % columns) * size - 20.0, (i // columns) * size - 20.0
        for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)), 1):
            rows.append((x + dx * size, y + dy * size, i + 1, k, code))
    return spark.createDataFrame(rows, "long double, lat double, `group` int, `order` int, iso3c string")


#: Scale denominators in millions by name.
SCALES = {"small": 110, "medium": 50, "large": 10}


def map_scale(scale) -> int:
    """110, 50 or 10 of a name or number."""
    if scale in SCALES.values():
        return int(scale)
    one_of("scale", scale, tuple(SCALES))
    return SCALES[scale]


def projected(frame: DataFrame, projection: str, recenter: float = 0.0) -> DataFrame:
    """frame with long and lat on the projection's plane (unit sphere); recenter is
    the middle longitude. Rings should be split there first (split_antimeridian)."""
    p = project(F.col("long"), F.col("lat"), projection, recenter)
    made = {"long": p["x"], "lat": p["y"]}
    return frame.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in frame.columns])


def world_geometry(frame: DataFrame, what: str = "countries", step: int = 15, region=None, projection: str | None = None, recenter: float = 0.0) -> DataFrame:
    """countries, centroids, points (inside), coastline, borders, graticule or ocean.

    The ocean is a box with the frame's rings as holes (even-odd, hole true). A
    region keeps its countries first; a projection moves countries and ocean.
    """
    one_of("what", what, ("countries", "centroids", "points", "coastline", "borders", "graticule", "ocean"))
    if region is not None:
        frame = frame.where(region_predicate(frame.sparkSession, region))
    if what == "countries":
        return projected(frame, projection, recenter) if projection else frame
    if what == "points":
        return interior_points(frame)
    if what == "centroids":
        return polygon_centroids(frame)
    if what in ("coastline", "borders"):
        return outline_edges(frame).where("n = 1" if what == "coastline" else "n > 1").drop("n")
    if what == "graticule":
        return graticule(frame.sparkSession, step)
    corners = [(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)]
    box = frame.sparkSession.createDataFrame([(x, y, 0, i + 1, False) for i, (x, y) in enumerate(corners)], "long double, lat double, `group` int, `order` int, hole boolean")
    land = frame.select("long", "lat", F.col("group").cast("int").alias("group"), F.col("order").cast("int").alias("order"), F.lit(True).alias("hole"))
    out = box.unionByName(land)
    return projected(out, projection, recenter) if projection else out
