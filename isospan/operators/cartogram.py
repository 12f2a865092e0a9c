"""Contiguous cartograms by rubber-sheet rounds.

In a round every country pushes or pulls all vertices from its middle, by how far
its area is from its share of the weights. The forces, a row for each country,
are broadcast; vertices move independently of each other, by their position
alone, so that those that outlines share stay shared.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpineError, need_columns
from ..shared import cut
from .nesting import nested_rings, signed_area
from .prefix import number

COUNTRIES = 10_000  # most countries whose forces are broadcast
CHUNK = 2048


def _middles(shapes: DataFrame) -> DataFrame:
    """(iso3c, area, cx, cy) of ring rows (iso3c, ring, hole)."""
    after = F.expr("concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1))")
    cross = lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]
    moment = lambda c: F.aggregate(F.zip_with("ring", after, lambda p, q: (p[c] + q[c]) * cross(p, q)), F.lit(0.0), lambda a, v: a + v) / 6
    a = signed_area(F.col("ring"))
    sign = F.signum(a) * F.when(F.col("hole"), -1.0).otherwise(1.0)
    per = shapes.select("iso3c", (sign * a).alias("a"), (sign * moment("lon")).alias("mx"), (sign * moment("lat")).alias("my"))
    per = per.groupBy("iso3c").agg(F.sum("a").alias("area"), F.sum("mx").alias("mx"), F.sum("my").alias("my")).where("area > 0")
    return per.select("iso3c", "area", (F.col("mx") / F.col("area")).alias("cx"), (F.col("my") / F.col("area")).alias("cy"))


def _forces(shapes: DataFrame, weights: DataFrame) -> tuple[list[tuple], float]:
    """([(cx, cy, radius, mass)], mean size error) of a round."""
    rows = _middles(shapes).join(F.broadcast(weights), "iso3c").orderBy("iso3c").limit(COUNTRIES + 1).collect()
    if len(rows) > COUNTRIES:
        raise SpineError(f"a cartogram of over {COUNTRIES} countries")
    area, weight = math.fsum(r["area"] for r in rows), math.fsum(r["w"] for r in rows)
    out, errors = [], []
    for r in rows:
        aim = area * r["w"] / weight
        radius = math.sqrt(r["area"] / math.pi)
        out.append((r["cx"], r["cy"], radius, math.sqrt(aim / math.pi) - radius))
        errors.append(max(r["area"], aim) / min(r["area"], aim))
    return out, math.fsum(errors) / len(errors) if errors else 1.0


def _moved(forces: list[tuple], reduction: float):
    import numpy as np

    cx, cy, radius, mass = (np.array(c) for c in zip(*forces))

    def push(xy):
        out = xy.copy()
        for at in range(0, len(xy), CHUNK):
            p = xy[at : at + CHUNK]
            dx, dy = p[:, :1] - cx, p[:, 1:] - cy
            d = np.maximum(np.sqrt(dx * dx + dy * dy), 1e-12)
            near = d / radius
            f = mass * np.where(d > radius, radius / d, near * near * (4 - 3 * near)) / d * reduction
            out[at : at + CHUNK, 0] += (f * dx).sum(axis=1)
            out[at : at + CHUNK, 1] += (f * dy).sum(axis=1)
        return out

    def batches(it):
        import pyarrow as pa

        for batch in it:
            column = batch.column(batch.schema.get_field_index("ring"))
            points = column.flatten()
            xy = push(np.stack([points.field(0).to_numpy(zero_copy_only=False), points.field(1).to_numpy(zero_copy_only=False)], axis=1)) if len(points) else np.zeros((0, 2))
            moved = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["lon", "lat"])
            offsets = pa.array(column.offsets.to_numpy() - column.offsets.to_numpy()[0], pa.int32())
            cols = [pa.ListArray.from_arrays(offsets, moved) if n == "ring" else batch.column(i) for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return batches


def contiguous_cartogram(df: DataFrame, weight: str, frame: DataFrame, rounds: int = 8, enough: float = 1.001) -> tuple[DataFrame, list[float]]:
    """(frame deformed so that areas follow the weights, mean size error before each round).

    df: a weight for each iso3c, the greatest where there are several; countries
    without one above 0 drop out. The error is the mean of the greater of area
    and aim over the lesser; rounds end when it is at most `enough`. Holes count
    out. Coordinates are planar: project before. The frame keeps its columns and
    rows, closed rings stay closed.
    """
    need_columns(df, "iso3c", weight)
    need_columns(frame, "iso3c", "group", "order", "long", "lat")
    w = cut(df.select("iso3c", number(weight).alias("w")).where("w > 0 and w < double('Infinity')").groupBy("iso3c").agg(F.max("w").alias("w")))
    known = frame.join(F.broadcast(w.select("iso3c")), "iso3c", "left_semi")
    kind = frame.schema["group"].dataType.simpleString()
    shapes = cut(nested_rings(known).select("iso3c", "group", "ring", (F.col("depth") % 2 == 1).alias("hole")))
    errors = []
    for _ in range(rounds):
        forces, error = _forces(shapes, w)
        errors.append(error)
        if not forces or error <= enough:
            break
        shapes = cut(shapes.mapInArrow(_moved(forces, 1 / (1 + error)), f"iso3c string, `group` {kind}, ring array<struct<lon: double, lat: double>>, hole boolean"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("iso3c", "group").orderBy("order")) - 1
    points = shapes.select(F.col("iso3c").alias("_i"), F.col("group").alias("_g"), F.posexplode("ring").alias("_n", "_p"))
    numbered = known.withColumn("_place", place)
    joined = numbered.join(points, (F.col("iso3c") == F.col("_i")) & (F.col("group") == F.col("_g")) & (F.col("_place") == F.col("_n")))
    made = {"long": F.col("_p.lon"), "lat": F.col("_p.lat")}
    return joined.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in frame.columns]), errors
