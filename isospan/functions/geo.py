"""Great circles, ring areas and map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import one_of

EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, n: int = 50) -> Column:
    """array<struct<ord, lon, lat>> of n points along the shorter arc.

    Equal ends give n copies; opposite ones, whose arc isn't defined, go by the
    same formula at a distance bounded away from a half turn.
    """
    p1, p2, l1, l2 = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    d = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2))))
    d = F.least(d, F.lit(math.pi - 1e-9))

    def point(i):
        f = i.cast("double") / max(1, n - 1)
        s = F.when(d == 0, F.lit(1.0)).otherwise(F.sin(d))
        a = F.when(d == 0, F.lit(1.0)).otherwise(F.sin((1 - f) * d) / s)
        b = F.when(d == 0, F.lit(0.0)).otherwise(F.sin(f * d) / s)
        x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
        y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
        z = a * F.sin(p1) + b * F.sin(p2)
        return F.struct((i + 1).cast("int").alias("ord"), F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def ring_area_km2(ring: Column) -> Column:
    """Spherical area of a ring array<struct<lon, lat>>; 0 for fewer than 3 points."""
    fine = F.filter(ring, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]))
    after = F.concat(F.slice(fine, 2, F.greatest(F.size(fine) - 1, F.lit(0))), F.slice(fine, 1, 1))
    pairs = F.zip_with(fine, after, lambda p, q: F.radians(q["lon"] - p["lon"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(fine) < 3, F.lit(0.0)).otherwise(F.abs(total) * EARTH_KM**2 / 2)


# Projections offered by name, with their projection string tags.
PROJECTIONS = {
    "equirectangular": "eqc", "robinson": "robin", "natural_earth": "natearth", "equal_earth": "eqearth", "mollweide": "moll",
    "mercator": "merc", "winkel_tripel": "wintri", "eckert4": "eck4", "orthographic": "ortho", "laea": "laea",
    "albers": "aea", "lambert_cylindrical": "cea", "gall_peters": "cea",
}


def projection_string(projection: str = "robinson", recenter: float = 0, lat0: float | None = None) -> str:
    one_of("projection", projection, tuple(PROJECTIONS))
    out = [f"+proj={PROJECTIONS[projection]}", f"+lon_0={recenter:g}"]
    if projection in ("orthographic", "laea"):
        out.append(f"+lat_0={lat0 or 0:g}")
    if projection == "albers":
        out.append("+lat_1=29.5 +lat_2=45.5")
    if projection == "gall_peters":
        out.append("+lat_ts=45")
    return " ".join([*out, "+datum=WGS84 +units=m +no_defs"])


def project(lon: Column, lat: Column, projection: str = "equal_earth", recenter: float = 0.0, lat0: float = 0.0) -> Column:
    """struct<x, y, visible> on the unit sphere; closed forms only."""
    lam = F.radians(F.pmod(lon - recenter + 540, F.lit(360.0)) - 180)
    phi = F.radians(lat)
    yes = F.lit(True)
    if projection == "equirectangular":
        x, y, seen = lam, phi, yes
    elif projection == "mercator":
        bounded = F.greatest(F.least(phi, F.lit(1.4844)), F.lit(-1.4844))
        x, y, seen = lam, F.log(F.tan(math.pi / 4 + bounded / 2)), yes
    elif projection in ("lambert_cylindrical", "gall_peters"):
        k = math.cos(math.radians(45)) if projection == "gall_peters" else 1.0
        x, y, seen = lam * k, F.sin(phi) / k, yes
    elif projection in ("orthographic", "laea"):
        p0 = math.radians(lat0)
        c = math.sin(p0) * F.sin(phi) + math.cos(p0) * F.cos(phi) * F.cos(lam)
        k = F.lit(1.0) if projection == "orthographic" else F.sqrt(2 / F.greatest(1 + c, F.lit(1e-12)))
        x, y = k * F.cos(phi) * F.sin(lam), k * (math.cos(p0) * F.sin(phi) - math.sin(p0) * F.cos(phi) * F.cos(lam))
        seen = c >= 0 if projection == "orthographic" else yes
    elif projection == "equal_earth":
        a = (1.340264, -0.081106, 0.000893, 0.003796)
        t = F.asin(math.sqrt(3) / 2 * F.sin(phi))
        t2 = t * t
        t6 = t2 * t2 * t2
        x = 2 * math.sqrt(3) * lam * F.cos(t) / (3 * (9 * a[3] * t6 * t2 + 7 * a[2] * t6 + 3 * a[1] * t2 + a[0]))
        y, seen = t * (a[0] + a[1] * t2 + t6 * (a[2] + a[3] * t2)), yes
    elif projection == "natural_earth":
        p2 = phi * phi
        p4 = p2 * p2
        x = lam * (0.8707 - 0.131979 * p2 + p4 * (-0.013791 + p4 * (0.003971 * p2 - 0.001529 * p4)))
        y, seen = phi * (1.007226 + p2 * (0.015085 + p4 * (-0.044475 + 0.028874 * p2 - 0.005916 * p4))), yes
    elif projection in ("mollweide", "eckert4"):
        moll = projection == "mollweide"
        aim = math.pi * F.sin(phi) if moll else (2 + math.pi / 2) * F.sin(phi)

        def newton(t):
            if moll:
                return t - (t + F.sin(t) - aim) / F.greatest(1 + F.cos(t), F.lit(1e-9))
            return t - (t + F.sin(t) * F.cos(t) + 2 * F.sin(t) - aim) / F.greatest(2 * F.cos(t) * (1 + F.cos(t)), F.lit(1e-9))

        t = F.aggregate(F.sequence(F.lit(1), F.lit(30)), phi if moll else phi / 2, lambda acc, _: newton(acc))
        if moll:
            x, y, seen = 2 * math.sqrt(2) / math.pi * lam * F.cos(t / 2), math.sqrt(2) * F.sin(t / 2), yes
        else:
            x, y, seen = 2 / math.sqrt(math.pi * (4 + math.pi)) * lam * (1 + F.cos(t)), 2 * math.sqrt(math.pi / (4 + math.pi)) * F.sin(t), yes
    elif projection == "winkel_tripel":
        al = F.acos(F.greatest(F.least(F.cos(phi) * F.cos(lam / 2), F.lit(1.0)), F.lit(-1.0)))
        sinc = F.when(al == 0, F.lit(1.0)).otherwise(F.sin(al) / al)
        x = (lam * 2 / math.pi + 2 * F.cos(phi) * F.sin(lam / 2) / sinc) / 2
        y, seen = (phi + F.sin(phi) / sinc) / 2, yes
    elif projection == "albers":
        s1, s2 = math.radians(29.5), math.radians(45.5)
        n = (math.sin(s1) + math.sin(s2)) / 2
        c = math.cos(s1) ** 2 + 2 * n * math.sin(s1)
        rho = F.sqrt(F.greatest(c - 2 * n * F.sin(phi), F.lit(0.0))) / n
        x, y, seen = rho * F.sin(n * lam), math.sqrt(c) / n - rho * F.cos(n * lam), yes
    else:
        one_of("projection", projection, tuple(PROJECTIONS))
        # The Robinson table, each 5 degrees of latitude.
        xs = [1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322, 0.5322]
        ys = [0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0, 1.0]
        at = F.abs(lat) / 5
        i = F.floor(at).cast("int")
        f = at - i
        pick = lambda t: F.element_at(F.array(*map(F.lit, t)), i + 1) * (1 - f) + F.element_at(F.array(*map(F.lit, t)), i + 2) * f
        x, y, seen = 0.8487 * lam * pick(xs), 1.3523 * pick(ys) * F.signum(phi), yes
    return F.struct(x.alias("x"), y.alias("y"), seen.alias("visible"))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring array<struct<lon, lat>>."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def crosses(p, q):
        spans = (p["lat"] > lat) != (q["lat"] > lat)
        at = p["lon"] + (lat - p["lat"]) / F.when(spans, q["lat"] - p["lat"]).otherwise(F.lit(1.0)) * (q["lon"] - p["lon"])
        return (spans & (lon < at)).cast("int")

    return F.aggregate(F.zip_with(ring, after, crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def ring_distance_km(lon: Column, lat: Column, ring: Column) -> Column:
    """Kilometres to the nearest point of a ring's edges (nearest in degrees)."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def nearest(p, q):
        dx, dy = q["lon"] - p["lon"], q["lat"] - p["lat"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(((lon - p["lon"]) * dx + (lat - p["lat"]) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        x, y = p["lon"] + t * dx, p["lat"] + t * dy
        return F.struct((F.pow(x - lon, 2) + F.pow(y - lat, 2)).alias("d2"), x.alias("x"), y.alias("y"))

    best = F.array_min(F.zip_with(ring, after, nearest))
    return haversine_km(lon, lat, best["x"], best["y"])
