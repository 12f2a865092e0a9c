"""Polygon frames, adjacency and point location.

A polygon frame has a row per vertex: iso3c, group (ring), order, long, lat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpineError, need_columns
from ..functions.geo import haversine_km, in_ring, ring_area_km2, ring_distance_km
from .prefix import free_names
from .resolve import convert_values, with_attributes

KM_A_DEGREE = 111.0
BROADCAST_VERTICES = 500_000  # some 12 MB of coordinates
TASKS = 1000  # at most so many for strips or tiles, one each where they are fewer


def rings(frame: DataFrame) -> DataFrame:
    """(iso3c, group, ring): vertices of each ring in order."""
    need_columns(frame, "iso3c", "group", "order", "long", "lat")
    points = F.sort_array(F.collect_list(F.struct("order", F.col("long").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))))
    out = frame.where("iso3c is not null").groupBy("iso3c", "group").agg(points.alias("_p"))
    return out.select("iso3c", "group", F.transform("_p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring"))


def ring_areas(frame: DataFrame) -> DataFrame:
    """(iso3c, group, area_km2) of each ring."""
    return rings(frame).select("iso3c", "group", ring_area_km2(F.col("ring")).alias("area_km2"))


def country_areas(frame: DataFrame) -> DataFrame:
    return ring_areas(frame).groupBy("iso3c").agg(F.sum("area_km2").alias("area_km2"))


def polygon_centroids(frame: DataFrame) -> DataFrame:
    """(iso3c, lon, lat): bounding-box middle of each country's largest ring, the first of equal ones."""
    r = rings(frame)
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    mid = F.struct(((F.array_min(lon) + F.array_max(lon)) / 2).alias("lon"), ((F.array_min(lat) + F.array_max(lat)) / 2).alias("lat"))
    best = F.max_by(mid, F.struct(ring_area_km2(F.col("ring")), -F.col("group")))
    return r.groupBy("iso3c").agg(best.alias("m")).select("iso3c", "m.lon", "m.lat")


def bbox_centroids(df: DataFrame, lon: str = "long", lat: str = "lat", key: str = "iso3c") -> DataFrame:
    """(key, lon, lat): bounding-box middle over all of a country's rows."""
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(mid(lon).alias("lon"), mid(lat).alias("lat"))


def ring_edges(frame: DataFrame) -> DataFrame:
    """(iso3c, group, p, q): the edges of each ring, the closing one included."""
    from pyspark.sql import Window

    need_columns(frame, "iso3c", "group", "order", "long", "lat")
    w = Window.partitionBy("group").orderBy("order")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct(F.col("long").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    edges = frame.where("iso3c is not null").select("iso3c", "group", at.alias("p"), F.coalesce(F.lead(at).over(w), F.first(at).over(ends)).alias("q"))
    return edges.where("p <> q")


def touching(frame: DataFrame, step: float = 1.0, slack: float = 1e-7) -> DataFrame:
    """(iso3c_a, iso3c_b), a < b: countries whose outlines have a point in common.

    Neighbours need not share vertices. Edges meet by grid cell, an equi-join;
    an edge's cells are those of its bounding box, so long edges should be rare.
    slack is the distance in degrees within which outlines touch.
    """
    axis = lambda a, b: F.sequence(F.floor((F.least(a, b) - slack) / step).cast("int"), F.floor((F.greatest(a, b) + slack) / step).cast("int"))
    placed = ring_edges(frame).drop("group").distinct().withColumn("cx", F.explode(axis(F.col("p.x"), F.col("q.x")))).withColumn("cy", F.explode(axis(F.col("p.y"), F.col("q.y"))))
    a, b = (placed.select("cx", "cy", *[F.col(c).alias(f"{c}_{s}") for c in ("iso3c", "p", "q")]) for s in "ab")

    def side(p, q, r):  # of which side of pq r lies, as a distance
        length = F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))
        return ((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])) / length

    def apart(s, t):
        return ((s > slack) & (t > slack)) | ((s < -slack) & (t < -slack))

    p, q, r, s = F.col("p_a"), F.col("q_a"), F.col("p_b"), F.col("q_b")
    boxes = F.lit(True)
    for c in ("x", "y"):
        boxes &= (F.least(p[c], q[c]) <= F.greatest(r[c], s[c]) + slack) & (F.least(r[c], s[c]) <= F.greatest(p[c], q[c]) + slack)
    meets = boxes & ~apart(side(p, q, r), side(p, q, s)) & ~apart(side(r, s, p), side(r, s, q))
    return a.join(b, ["cx", "cy"]).where("iso3c_a < iso3c_b").where(meets).select("iso3c_a", "iso3c_b").distinct()


def interior_points(frame: DataFrame) -> DataFrame:
    """(iso3c, lon, lat): a point inside each country, also where its middle is not.

    On the latitude halfway up the largest ring, the middle of the widest stretch
    that is inside the country, holes left out.
    """
    parts = rings(frame).withColumn("area", ring_area_km2(F.col("ring")))
    best = parts.groupBy("iso3c").agg(F.max_by("ring", F.struct("area", -F.col("group"))).alias("top"), F.collect_list("ring").alias("rings"))
    ys = F.transform("top", lambda p: p["lat"])
    best = best.withColumn("y", F.array_min(ys) * 0.4999 + F.array_max(ys) * 0.5001)  # off vertices at the very middle

    def crossings(ring):
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        at = F.zip_with(ring, after, lambda p, q: F.when((p["lat"] > F.col("y")) != (q["lat"] > F.col("y")), p["lon"] + (F.col("y") - p["lat"]) / (q["lat"] - p["lat"]) * (q["lon"] - p["lon"])))
        return F.array_compact(at)

    best = best.withColumn("x", F.array_sort(F.flatten(F.transform("rings", crossings))))
    widths = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda i: F.struct((F.get("x", 2 * i + 1) - F.get("x", 2 * i)).alias("w"), ((F.get("x", 2 * i + 1) + F.get("x", 2 * i)) / 2).alias("m")))
    return best.where(F.size("x") > 1).select("iso3c", F.array_max(widths)["m"].alias("lon"), F.col("y").alias("lat"))


def place_among(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below x: a binary search."""
    if not cuts:
        return F.lit(0)
    held = F.array(*map(F.lit, cuts))
    halves = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    step = lambda at, h: at + F.when(F.coalesce(F.get(held, at + h - 1) < x, F.lit(False)), h).otherwise(F.lit(0))
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step)


def _left(p, q, r) -> float:
    """Angle from going p -> q to going q -> r, left being positive."""
    ax, ay, bx, by = q[0] - p[0], q[1] - p[1], r[0] - q[0], r[1] - q[1]
    return math.atan2(ax * by - ay * bx, ax * bx + ay * by)


def stretches(edges: list[tuple], here: list[bool]) -> list[tuple]:
    """[(closed, entry, exit, [edge, ...])] of the directed edges (x0, y0, x1, y1) that start here.

    The others only come in. Where several meet, the sharpest left turn is taken.
    entry: the edge from elsewhere that goes before, exit: the last one, if it ends
    elsewhere; else None.
    """
    into, out_of = {}, {}
    for i, (x0, y0, x1, y1) in enumerate(edges):
        into.setdefault((x1, y1), []).append(i)
        if here[i]:
            out_of.setdefault((x0, y0), []).append(i)
    before, after = {}, {}
    for node, outs in out_of.items():
        ins = into.get(node, ())
        if len(ins) == 1 == len(outs):
            before[outs[0]], after[ins[0]] = ins[0], outs[0]
        else:
            for _, i, o in sorted((-_left(edges[i][:2], node, edges[o][2:]), i, o) for i in ins for o in outs):
                if o not in before and i not in after:
                    before[o], after[i] = i, o
    done, found = set(), []

    def walk(i):
        path = []
        while i is not None and i not in done and here[i]:
            done.add(i)
            path.append(i)
            i = after.get(i)
        return path

    for i in range(len(edges)):
        if here[i] and not (i in before and here[before[i]]):
            path = walk(i)
            found.append((False, before.get(i), path[-1] if path[-1] not in after else None, path))
    for i in range(len(edges)):
        if here[i] and i not in done:
            found.append((True, None, None, walk(i)))
    return found


TILE_EDGES = 50_000


def dissolve(frame: DataFrame, by: str, digits: int = 6, tile_edges: int = TILE_EDGES) -> DataFrame:
    """(by, group, order, long, lat): the union of the rings of each value of by.

    For meshes whose neighbours share edges: an edge of two rings of one value
    goes, the others are chained into rings. Rings are numbered by their least
    vertices, with which they begin.

    The plane is cut into tiles of about tile_edges edges, a task's work, in which
    edges are chained; of one value's stretches only the ends, one row each, meet.
    """
    from pyspark.sql import Window

    from ..shared import cut

    need_columns(frame, by)
    coded = frame.select("iso3c", by).distinct() if by != "iso3c" else None
    edges = ring_edges(frame)
    if coded is not None:
        edges = edges.join(coded, "iso3c")
    at = lambda c: F.struct(F.round(F.col(f"{c}.x"), digits).alias("x"), F.round(F.col(f"{c}.y"), digits).alias("y"))
    flat = edges.select(by, at("p").alias("p"), at("q").alias("q")).where("p <> q")
    ahead = F.when(F.col("p") < F.col("q"), 1).otherwise(-1)
    flat = flat.select(by, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), ahead.alias("d"))
    once = flat.groupBy(by, "a", "b").agg(F.sum("d").alias("d")).where("d % 2 <> 0")
    p, q = (F.when(F.col("d") > 0, F.col(u)).otherwise(F.col(v)) for u, v in ("ab", "ba"))
    once = cut(once.select(by, p.alias("p"), q.alias("q")).select(by, F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1")))
    sides = math.ceil(math.sqrt(once.count() / tile_edges))
    cuts: dict = {"x": [], "y": []}
    if sides > 1:
        probs = [i / sides for i in range(1, sides)]
        row = once.agg(*[F.percentile_approx(f"{c}0", probs, 10 * sides).alias(c) for c in "xy"]).first()
        cuts = {c: sorted(set(row[c])) for c in "xy"}
    tile = lambda i: place_among(F.col(f"x{i}"), cuts["x"]) * (len(cuts["y"]) + 1) + place_among(F.col(f"y{i}"), cuts["y"])
    placed = once.withColumns({"_t0": tile(0), "_t1": tile(1)})
    own = placed.withColumn("tile", F.explode(F.array_distinct(F.array("_t0", "_t1")))).withColumn("here", F.col("_t0") == F.col("tile")).drop("_t0", "_t1")

    kind = frame.schema[by].dataType.simpleString()
    place = "struct<x0: double, y0: double, x1: double, y1: double>"

    def chain(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["x0", "y0", "x1", "y1"], kind="stable")
        t, rows = int(pdf["tile"].iloc[0]), []
        for _, one in pdf.groupby(pd.factorize(pdf[by], use_na_sentinel=False)[0], sort=False):
            ends = list(zip(*(one[c].tolist() for c in ("x0", "y0", "x1", "y1"))))
            for closed, entry, leaving, path in stretches(ends, one["here"].tolist()):
                points = [ends[i][:2] for i in path]
                least = min(range(len(points)), key=points.__getitem__)
                edge = lambda i: None if i is None else dict(zip(("x0", "y0", "x1", "y1"), ends[i]))  # noqa: E731, B023
                rows.append((one[by].iloc[0], (t << 32) + len(rows), closed, edge(entry), edge(leaving), len(points), *points[least], least, [{"x": x, "y": y} for x, y in points]))
        return pd.DataFrame(rows, columns=[by, "part", "closed", "entry", "leaving", "n", "x", "y", "least", "points"])

    own = own.repartition(min(TASKS, (len(cuts["x"]) + 1) * (len(cuts["y"]) + 1)), "tile")
    parts = cut(own.groupBy("tile").applyInPandas(chain, f"`{by}` {kind}, part long, closed boolean, entry {place}, leaving {place}, n int, x double, y double, least int, points array<struct<x: double, y: double>>"))

    def joined(pdf):
        import pandas as pd

        key = lambda e: tuple(e.values()) if isinstance(e, dict) else tuple(e)
        known = {p: (n, (x, y), least) for p, n, x, y, least in zip(*(pdf[c].tolist() for c in ("part", "n", "x", "y", "least")))}
        starts = {key(e): p for e, p in zip(pdf["entry"], pdf["part"].tolist()) if e is not None}
        after = {p: starts.get(key(e)) for e, p in zip(pdf["leaving"], pdf["part"].tolist()) if e is not None}
        heads = sorted(set(known) - {p for p in after.values() if p is not None})
        rows, done = [], set()
        for first in [*heads, *sorted(known)]:
            run, here = [], first
            while here is not None and here not in done:
                done.add(here)
                run.append(here)
                here = after.get(here)
            if not run:
                continue
            offsets = [0]
            for p in run:
                offsets.append(offsets[-1] + known[p][0])
            spot, k = min((known[p][1], k) for k, p in enumerate(run))
            begin = offsets[k] + known[run[k]][2] if here == first else 0  # open ones keep their start
            rows += [(pdf[by].iloc[0], p, first, offsets[j], offsets[-1], begin, *spot) for j, p in enumerate(run)]
        return pd.DataFrame(rows, columns=[by, "part", "ring", "offset", "total", "begin", "x", "y"])

    ends = parts.where("not closed").select(by, "part", "entry", "leaving", "n", "x", "y", "least")
    open_ones = ends.groupBy(by).applyInPandas(joined, f"`{by}` {kind}, part long, ring long, offset int, total int, begin int, x double, y double")
    whole = parts.where("closed").select(by, "part", F.col("part").alias("ring"), F.lit(0).alias("offset"), F.col("n").alias("total"), F.col("least").alias("begin"), "x", "y")
    places = cut(open_ones.unionByName(whole))
    ranks = places.groupBy(by, "ring").agg(F.min("x").alias("x"), F.min("y").alias("y")).withColumn("group", F.row_number().over(Window.partitionBy(by).orderBy("x", "y", "ring")))
    rows = places.drop("x", "y").join(ranks.select("ring", "group"), "ring").join(parts.select("part", "points"), "part")
    spread = rows.select(by, "group", "offset", "total", "begin", F.posexplode("points").alias("i", "p"))
    return spread.select(by, F.col("group").cast("int").alias("group"), (F.pmod(F.col("offset") + F.col("i") - F.col("begin"), F.col("total")) + 1).cast("int").alias("order"), F.col("p.x").alias("long"), F.col("p.y").alias("lat"))


def country_borders(frame: DataFrame, digits: int = 6, names: bool = False) -> DataFrame:
    """(iso3c_a, iso3c_b), a < b: countries whose rings share a vertex.

    An equi-join on rounded vertices; for meshes whose neighbours share them.
    A vertex of many countries gives only its distinct pairs.
    """
    need_columns(frame, "iso3c", "long", "lat")
    at = frame.where("iso3c is not null").groupBy(F.round("long", digits).alias("x"), F.round("lat", digits).alias("y")).agg(F.sort_array(F.collect_set("iso3c")).alias("c")).where("size(c) > 1")
    pairs = at.select(F.col("c"), F.explode("c").alias("iso3c_a")).select("iso3c_a", F.explode("c").alias("iso3c_b")).where("iso3c_a < iso3c_b").distinct()
    if not names:
        return pairs
    from ..refdata.crosswalk import crosswalk

    known = crosswalk(frame.sparkSession).select("iso3c", "country")
    for side in ("a", "b"):
        pairs = pairs.join(F.broadcast(known.toDF(f"iso3c_{side}", f"country_{side}")), f"iso3c_{side}", "left")
    return pairs.select("iso3c_a", "country_a", "iso3c_b", "country_b")


def neighbors(edges: DataFrame, countries: list, origin: str = "country.name") -> DataFrame:
    """(iso3c, neighbor) of the given countries; islands have no rows."""
    codes = [c for c in convert_values(edges.sparkSession, list(countries), "iso3c", origin) if c]
    both = edges.select(F.col("iso3c_a").alias("iso3c"), F.col("iso3c_b").alias("neighbor"))
    both = both.unionByName(edges.select(F.col("iso3c_b").alias("iso3c"), F.col("iso3c_a").alias("neighbor")))
    return both.where(F.col("iso3c").isin(codes)).distinct().orderBy("iso3c", "neighbor")


def distance_between(df: DataFrame, a: str, b: str, centroids: DataFrame, out: str = "distance_km") -> DataFrame:
    """df with the great-circle kilometres between the centroids of two code columns."""
    need_columns(df, a, b)
    work = df
    for i, c in enumerate((a, b)):
        table = centroids.select(F.col("iso3c").alias(f"_k{i}"), F.col("lon").alias(f"_lon{i}"), F.col("lat").alias(f"_lat{i}"))
        work = work.join(F.broadcast(table), F.col(f"`{c}`") == F.col(f"_k{i}"), "left")
    return work.withColumn(out, haversine_km(F.col("_lon0"), F.col("_lat0"), F.col("_lon1"), F.col("_lat1"))).select(*df.columns, out)


def locate_country(points: DataFrame, frame: DataFrame, lon: str = "lon", lat: str = "lat", tolerance_km: float = 25.0, add: tuple = (), step: float = 2.0, out: str = "iso3c") -> DataFrame:
    """points with the country that contains each, else the nearest within tolerance_km.

    Even-odd over a country's rings, so holes count out; the first country (by
    ring group) wins. Points and countries meet by grid cell, an equi-join on
    cells, which wrap at 180 degrees; a country's cells come from its bounding
    box, widened by the tolerance. Its rings then come by broadcast where the
    frame has at most BROADCAST_VERTICES vertices, else with its cells.
    """
    need_columns(points, lon, lat)
    if tolerance_km < 0:
        raise SpineError("tolerance_km must not be negative")
    # longest east-west reach of the tolerance at the polygon's own latitudes
    polys = rings(frame).groupBy("iso3c").agg(F.min("group").alias("first"), F.collect_list("ring").alias("rings"))
    xs, ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["lon"]))), F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["lat"])))
    polys = polys.select("iso3c", "first", "rings", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    ry = tolerance_km / KM_A_DEGREE
    rx = F.least(F.lit(180.0), F.lit(ry) / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("y0"), F.abs("y1")) + ry))), F.lit(0.01)))
    shape = F.struct("first", "rings", ((F.col("x0") + F.col("x1")) / 2).alias("mid")).alias("shape")
    wide = polys.select("iso3c", shape, "x0", "x1", "y0", "y1", rx.alias("rx"))
    axis = lambda a, b: F.sequence(F.floor(a / step).cast("int"), F.floor(b / step).cast("int"))
    around = int(360 / step) if (360 / step).is_integer() else None
    column = lambda c: F.pmod(c, F.lit(around)) if around else c
    placed = wide.withColumn("cx", F.explode(F.array_distinct(F.transform(axis(F.col("x0") - F.col("rx"), F.col("x1") + F.col("rx")), column))))
    placed = placed.withColumn("cy", F.explode(axis(F.col("y0") - ry, F.col("y1") + ry)))
    spot, at, found = free_names(points, "spot", "at", "found")
    keyed = points.withColumn(spot, F.struct(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")))
    spots = keyed.select(F.col(spot).alias("at")).where("at.x is not null and at.y is not null").distinct()
    spots = spots.withColumn("cx", column(F.floor(F.col("at.x") / step).cast("int"))).withColumn("cy", F.floor(F.col("at.y") / step).cast("int"))
    if frame.limit(BROADCAST_VERTICES + 1).count() <= BROADCAST_VERTICES:
        met = spots.join(placed.select("cx", "cy", "iso3c"), ["cx", "cy"]).join(F.broadcast(wide.select("iso3c", "shape")), "iso3c")
    else:
        met = spots.join(placed.select("cx", "cy", "iso3c", "shape"), ["cx", "cy"])
    # the copy of the point that is nearest to the country's middle
    x, y, parts = F.col("at.x") - 360 * F.round((F.col("at.x") - F.col("shape.mid")) / 360), F.col("at.y"), F.col("shape.rings")
    inside = F.aggregate(parts, F.lit(0), lambda a, r: a + in_ring(x, y, r).cast("int")) % 2 == 1
    met = met.withColumn("inside", inside)
    far = F.when(F.col("inside"), F.lit(0.0)).otherwise(F.array_min(F.transform(parts, lambda r: ring_distance_km(x, y, r))))
    met = met.withColumn("km", far if tolerance_km > 0 else F.when(F.col("inside"), F.lit(0.0)))
    best = met.where(F.col("km") <= tolerance_km).groupBy("at").agg(F.min_by("iso3c", F.struct("km", "shape.first", "iso3c")).alias(found))
    joined = keyed.join(best.select(F.col("at").alias(at), found), F.col(spot) == F.col(at), "left")
    kept = [F.col(f"`{c}`") for c in points.columns if c != out]
    return with_attributes(joined.select(*kept, F.col(found).alias(out)), add, out)


def effective_areas(points: list[tuple], fixed: list[bool]) -> list[float]:
    """For each vertex of a ring, the area of the triangle it made with its
    neighbours when it was the least one left to drop, never less than of those
    dropped before it; infinite for fixed vertices.

    The ring is read from its least fixed (or least) vertex in the direction of
    the lesser neighbour, stretch by stretch between fixed ones, so that rings
    that share a stretch get the same areas for it.
    """
    import heapq

    n = len(points)
    if n < 4:
        return [float("inf")] * n
    pinned = [i for i in range(n) if fixed[i]] or [min(range(n), key=lambda i: points[i])]
    out = [float("inf")] * n

    def stretch(path):
        if points[path[-1]] < points[path[0]] or (points[path[0]] == points[path[-1]] and points[path[-2]] < points[path[1]]):
            path = path[::-1]
        before, after = {b: a for a, b in zip(path, path[1:])}, {a: b for a, b in zip(path, path[1:])}
        first, last = path[0], path[-1]

        def area(i):
            (x0, y0), (x1, y1), (x2, y2) = points[before[i]], points[i], points[after[i]]
            return abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2

        now = {i: area(i) for i in path[1:-1]}
        heap, done = [(a, points[i], i) for i, a in now.items()], 0.0
        heapq.heapify(heap)
        while heap:
            a, _, i = heapq.heappop(heap)
            if now.get(i) != a:
                continue
            out[i] = done = max(done, a)
            del now[i]
            p, q = before[i], after[i]
            after[p], before[q] = q, p
            for j in (p, q):
                if j in now:
                    now[j] = area(j)
                    heapq.heappush(heap, (now[j], points[j], j))
        return first, last

    for a, b in zip(pinned, [*pinned[1:], pinned[0] + n]):
        path = [i % n for i in range(a, b + 1)]
        if len(path) > 2 and path[0] != path[-1]:
            stretch(path)
        elif len(path) > 2:  # one pinned vertex: cut the ring at it and at the farthest one
            far = max(path[1:-1], key=lambda i: ((points[i][0] - points[a][0]) ** 2 + (points[i][1] - points[a][1]) ** 2, points[i]))
            at = path.index(far)
            for part in (path[: at + 1], path[at:]):
                if len(part) > 2:
                    stretch(part)
    return out


def simplify_geometry(frame: DataFrame, keep: float = 0.05) -> DataFrame:
    """A polygon frame with about `keep` of its vertices.

    The vertex whose triangle with its neighbours is least goes first, areas
    being worked out again as neighbours go; one limit holds for the whole
    frame. Vertices where outlines meet or part stay, and a stretch that two
    rings share keeps the same vertices in both. Rings keep four vertices or more.
    """
    need_columns(frame, "iso3c", "group", "order", "long", "lat")
    if not 0 < keep <= 1:
        raise SpineError("keep must be above 0 and at most 1")
    from pyspark.sql import types as T

    from ..shared import cut

    edges = ring_edges(frame.withColumns({"long": F.round("long", 6), "lat": F.round("lat", 6)})).select("p", "q")
    joints = edges.union(edges.select("q", "p")).distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    x, y, joint, size, least, place = free_names(frame, "x", "y", "joint", "size", "least", "place")
    joints = joints.select(F.col("p.x").alias(x), F.col("p.y").alias(y), F.lit(True).alias(joint))
    flagged = frame.join(joints, (F.round("long", 6) == F.col(x)) & (F.round("lat", 6) == F.col(y)), "left").select(*frame.columns, F.coalesce(joint, F.lit(False)).alias(joint))

    def sized(batches):
        for pdf, starts in whole_groups(batches, "group"):
            points = list(zip(pdf["long"].round(6).tolist(), pdf["lat"].round(6).tolist()))
            fixed, orders = pdf[joint].tolist(), pdf["order"].tolist()
            sizes, places = [], [0] * len(pdf)
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                closed = b - a > 1 and points[a] == points[b - 1]
                got = effective_areas(points[a : b - closed], fixed[a : b - closed])
                sizes += got + got[:1] * closed
                for n, i in enumerate(sorted(range(a, b), key=lambda i: (-sizes[i], orders[i])), 1):
                    places[i] = n
            yield pdf.drop(columns=joint).assign(**{size: sizes, place: places})

    dealt = flagged.repartition("group").sortWithinPartitions("group", "order")
    fields = [*frame.schema.fields, T.StructField(size, T.DoubleType()), T.StructField(place, T.IntegerType())]
    work = cut(dealt.mapInPandas(sized, T.StructType(fields)))
    limit = work.agg(F.percentile_approx(size, 1 - keep, 10000).alias(least))
    return work.crossJoin(F.broadcast(limit)).where((F.col(size) >= F.col(least)) | (F.col(place) <= 4)).select(*frame.columns)


def whole_groups(batches, key: str):
    """(rows, first places of groups) of sorted batches, no group in two; null keys are a group."""
    import numpy as np
    import pandas as pd

    held: list = []

    def starts(pdf):
        k, n = pdf[key].to_numpy(), pdf[key].isna().to_numpy()
        return [0, *(np.flatnonzero(((k[1:] != k[:-1]) & ~(n[1:] & n[:-1])) | (n[1:] != n[:-1])) + 1).tolist()]

    for pdf in batches:
        if not len(pdf):
            continue
        cut_at = starts(pdf)[-1]
        first, last = pdf[key].iloc[0], held[-1][key].iloc[-1] if held else None
        goes_on = held and (first == last or (pd.isna(first) and pd.isna(last)))
        if cut_at or not goes_on:
            made = [*held, pdf.iloc[:cut_at]] if cut_at else held
            held = [pdf.iloc[cut_at:]]
            if made:
                out = pd.concat(made, ignore_index=True)
                yield out, starts(out)
        else:
            held.append(pdf)
    if held:
        out = pd.concat(held, ignore_index=True)
        yield out, starts(out)


def split_antimeridian(frame: DataFrame) -> DataFrame:
    """Rings that jump across +-180 degrees, as an eastern and a western part.

    Each part keeps its vertices and gets the crossing points; group becomes
    2 * group for the eastern part and 2 * group + 1 for the western one.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("group").orderBy("order")
    nlon, nlat = F.lead("long").over(w), F.lead("lat").over(w)
    jump = F.abs(nlon - F.col("long")) > 180
    edge = F.signum("long") * 180
    t = F.abs(edge - F.col("long")) / F.greatest(360 - F.abs(nlon - F.col("long")), F.lit(1e-12))
    at = F.col("lat") + t * (nlat - F.col("lat"))
    own = F.struct(F.col("long").alias("long"), F.col("lat").alias("lat"), F.lit(0).alias("k"))
    rows = F.when(jump, F.array(own, F.struct(edge.cast("double").alias("long"), at.alias("lat"), F.lit(1).alias("k")), F.struct((-edge).cast("double").alias("long"), at.alias("lat"), F.lit(2).alias("k")))).otherwise(F.array(own))
    work = frame.withColumn("_rows", rows).withColumn("_jump", F.coalesce(jump.cast("int"), F.lit(0)))
    work = work.withColumn("_crossed", F.max("_jump").over(Window.partitionBy("group")))
    long = work.withColumn("_r", F.explode("_rows"))
    part = F.when(F.col("_crossed") == 0, F.col("group") * 2).otherwise(F.col("group") * 2 + (F.col("_r.long") < 0).cast("int"))
    made = {"long": F.col("_r.long"), "lat": F.col("_r.lat"), "group": part, "order": (F.col("order") * 3 + F.col("_r.k")).cast("int")}
    return long.select(*[made[c].alias(c) if c in made else F.col(c) for c in frame.columns])


def clip_box(frame: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rings cut to a box (Sutherland-Hodgman, one side after the other)."""
    keys = [c for c in frame.columns if c not in ("long", "lat", "order")]

    def clip(pdf):
        import pandas as pd

        pts = list(zip(pdf.sort_values("order")["long"], pdf.sort_values("order")["lat"]))
        for axis, limit, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
            out = []
            for p, q in zip(pts, pts[1:] + pts[:1]):
                a, b = sign * (p[axis] - limit) >= 0, sign * (q[axis] - limit) >= 0
                if a:
                    out.append(p)
                if a != b:
                    t = (limit - p[axis]) / (q[axis] - p[axis])
                    out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            pts = out
        first = pdf.iloc[0]
        made = {"long": [p[0] for p in pts], "lat": [p[1] for p in pts], "order": list(range(1, len(pts) + 1))}
        return pd.DataFrame({c: pd.Series([first[c]] * len(pts), dtype=object) if c in keys else pd.Series(made[c], dtype=pdf[c].dtype) for c in pdf.columns})

    return frame.groupBy("group").applyInPandas(clip, frame.schema)


def outline_edges(frame: DataFrame, digits: int = 6) -> DataFrame:
    """(x0, y0, x1, y1, n): each undirected ring edge and in how many rings it is.

    n = 1 is coastline, n > 1 a border.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("group").orderBy("order")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.struct(F.round("long", digits).alias("x"), F.round("lat", digits).alias("y"))
    q = F.struct(F.round(F.coalesce(F.lead("long").over(w), F.first("long").over(ends)), digits).alias("x"), F.round(F.coalesce(F.lead("lat").over(w), F.first("lat").over(ends)), digits).alias("y"))
    e = frame.select(p.alias("p"), q.alias("q")).where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select(F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "n")


def graticule(spark, step: int = 15) -> DataFrame:
    """(line, ord, long, lat): meridians and parallels each `step` degrees."""
    ords = spark.range(0, 73).withColumnRenamed("id", "ord")
    mer = spark.range(0, 360 // step + 1).select((F.col("id") * step - 180).cast("double").alias("v")).crossJoin(ords).select(F.concat(F.lit("m"), F.col("v").cast("int")).alias("line"), F.col("ord").cast("int").alias("ord"), F.col("v").alias("long"), (F.col("ord") * 2.5 - 90).alias("lat"))
    par = spark.range(1, 180 // step).select((F.col("id") * step - 90).cast("double").alias("v")).crossJoin(ords).select(F.concat(F.lit("p"), F.col("v").cast("int")).alias("line"), F.col("ord").cast("int").alias("ord"), (F.col("ord") * 5.0 - 180).alias("long"), F.col("v").alias("lat"))
    return mer.unionByName(par)
