"""The visible side of outlines on a globe.

Rings are cut where they cross the limb, the great circle around the point seen;
stretches that leave are joined to where the outline comes back by arcs of it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import need_columns
from .prefix import free_names

INWARDS = 1e-9  # how far limb points lie on the visible side


def visible_parts(points: list[tuple], lon0: float, lat0: float, step: float = 2.0) -> list[list[tuple]]:
    """[[(long, lat, limb)]]: the parts of a ring (long, lat) seen from above (lon0, lat0).

    limb says that a point is on the limb. Rings keep their turn; a ring whose
    inside is all that is visible becomes the limb.
    """
    if len(points) > 1 and points[0] == points[-1]:
        points = points[:-1]
    if len(points) < 3:
        return []
    rad = math.radians
    east = (-math.sin(rad(lon0)), math.cos(rad(lon0)), 0.0)
    centre = (math.cos(rad(lat0)) * math.cos(rad(lon0)), math.cos(rad(lat0)) * math.sin(rad(lon0)), math.sin(rad(lat0)))
    north = (centre[1] * east[2] - centre[2] * east[1], centre[2] * east[0] - centre[0] * east[2], centre[0] * east[1] - centre[1] * east[0])
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]

    def at(angle):
        c, s = math.cos(angle), math.sin(angle)
        p = [c * e + s * n + INWARDS * z for e, n, z in zip(east, north, centre)]
        return math.degrees(math.atan2(p[1], p[0])), math.degrees(math.atan2(p[2], math.hypot(p[0], p[1])))

    def arc(a, b):  # points strictly between two angles, turning left
        n = int(((b - a) % math.tau) // rad(step)) + 1
        return [(*at(a + ((b - a) % math.tau) * i / n), True) for i in range(1, n)]

    area = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]))
    turned = area < 0
    ring = points[::-1] if turned else list(points)
    xyz = [(math.cos(rad(y)) * math.cos(rad(x)), math.cos(rad(y)) * math.sin(rad(x)), math.sin(rad(y))) for x, y in ring]
    seen = [dot(p, centre) for p in xyz]
    back = lambda r: r[::-1] if turned else r
    if all(d >= 0 for d in seen):
        return [[(x, y, False) for x, y in points]]
    if not any(d >= 0 for d in seen):
        hit = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > lat0) != (y1 > lat0) and lon0 < x0 + (lat0 - y0) / (y1 - y0) * (x1 - x0):
                hit = not hit
        return [back([(*at(0.0), True), *arc(0.0, math.tau - 1e-12)])] if hit else []

    def crossing(i, j):
        t = seen[i] / (seen[i] - seen[j])
        p = [a + t * (b - a) for a, b in zip(xyz[i], xyz[j])]
        return math.atan2(dot(p, north), dot(p, east))

    n, chains = len(ring), []
    starts = [i for i in range(n) if seen[i] >= 0 > seen[i - 1]]
    for i in starts:
        chain, j = [], i
        while seen[j % n] >= 0:
            chain.append((*ring[j % n], False))
            j += 1
        enter, leave = crossing(i - 1, i), crossing((j - 1) % n, j % n)
        chains.append((enter, leave, [(*at(enter), True), *chain, (*at(leave), True)]))
    # leaving the visible side, an outline with its inside on the left goes on left around the limb
    out, left = [], set(range(len(chains)))
    while left:
        first = here = min(left)
        made = []
        while True:
            left.discard(here)
            made += chains[here][2]
            leave = chains[here][1]
            there = min([*left, first], key=lambda k: (chains[k][0] - leave) % math.tau)
            made += arc(leave, chains[there][0])
            here = there
            if here == first:
                break
        out.append(back(made))
    return out


def clip_globe(frame: DataFrame, lon: float = 0.0, lat: float = 0.0, step: float = 2.0) -> DataFrame:
    """frame's rings cut to the half of the globe seen from above (lon, lat).

    Columns are frame's, then part (from 1 within a group) and limb: points put
    in on the limb, at most `step` degrees apart. Draw by group and part. Rings
    out of sight have no rows; columns that differ within a ring take its first
    row's values. Rings shouldn't span 180 degrees of longitude or more.
    """
    need_columns(frame, "group", "order", "long", "lat")
    part, limb = free_names(frame, "part", "limb")
    rest = [f for f in frame.schema if f.name not in ("order", "long", "lat")]
    keep = T.StructType(rest)
    parts = "array<array<struct<long: double, lat: double, limb: boolean>>>"

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for points in batch.column(0).to_pylist():
                own = visible_parts([(p["long"], p["lat"]) for p in points], lon, lat, step)
                made.append([[{"long": x, "lat": y, "limb": on} for x, y, on in part] for part in own])
            kind = pa.list_(pa.list_(pa.struct([("long", pa.float64()), ("lat", pa.float64()), ("limb", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([pa.array(made, kind), batch.column(1)], names=["parts", "keep"])

    point = F.struct("order", F.col("long").cast("double").alias("long"), F.col("lat").cast("double").alias("lat"))
    rows = frame.where(F.col("long").isNotNull() & F.col("lat").isNotNull())
    rings = rows.groupBy("group").agg(F.sort_array(F.collect_list(point)).alias("points"), F.min_by(F.struct(*[F.col(f"`{f.name}`") for f in rest]), "order").alias("keep")).select("points", "keep")
    schema = T.StructType([T.StructField("parts", T._parse_datatype_string(parts)), T.StructField("keep", keep)])
    out = rings.mapInArrow(cut, schema).select("keep", F.posexplode("parts").alias("_part", "_ring")).select("keep", "_part", F.posexplode("_ring").alias("_i", "_p"))
    made = {f.name: F.col("keep")[f.name] for f in rest}
    made |= {c: F.col(f"_p.{c}").cast(frame.schema[c].dataType) for c in ("long", "lat")} | {"order": (F.col("_i") + 1).cast(frame.schema["order"].dataType)}
    return out.select(*[made[c].alias(c) for c in frame.columns], (F.col("_part") + 1).cast("int").alias(part), F.col("_p.limb").alias(limb))
