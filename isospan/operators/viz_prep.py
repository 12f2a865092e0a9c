"""Data behind maps: classes, symbols, tiles, arcs, frames and chart specifications."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpineError, need_columns, one_of
from ..functions.geo import great_circle, haversine_km, project
from ..functions.stats import natural_breaks
from .aggregate import keep_first
from .joins import spine_join
from .prefix import free_names, window_fits
from .quantiles import exact_quantiles
from .resolve import resolved

JENKS_VALUES = 20_000_000  # distinct values that the driver takes in arrays


def one_per_country(df: DataFrame, value: str) -> DataFrame:
    """(iso3c, value): one row per country of a table or polygon frame."""
    need_columns(df, "iso3c", value)
    return df.groupBy("iso3c").agg(F.min(value).alias(value)) if "group" in df.columns else df.select("iso3c", value)


def compute_breaks(df: DataFrame, value: str, style: str = "quantile", n_bins: int = 5) -> list[float]:
    """Class limits over one value per country, least and greatest included.

    quantile: interpolated quantiles; equal: equal widths; jenks: natural breaks
    of the distinct values and their counts, which alone reach the driver, as
    arrays; over JENKS_VALUES are an error, never another result.
    """
    one_of("style", style, ("quantile", "equal", "jenks"))
    v = one_per_country(df, value).select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    if style == "quantile":
        probs = [i / n_bins for i in range(n_bins + 1)]
        if window_fits(v, []):
            got = v.agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("b")).first()["b"] or []
        else:
            got = [r["quantile"] for r in exact_quantiles(v, "v", probs).collect()]
    elif style == "equal":
        lo, hi = v.agg(F.min("v"), F.max("v")).first()
        got = [] if lo is None else [lo + (hi - lo) * i / n_bins for i in range(n_bins + 1)]
    else:
        counts = v.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        if counts.limit(JENKS_VALUES + 1).count() > JENKS_VALUES:
            raise SpineError(f"natural breaks of over {JENKS_VALUES} distinct values; aggregate them, or take quantiles")
        held = counts.toArrow()
        got = natural_breaks(held["v"].to_numpy(), n_bins, held["n"].to_numpy())
    return sorted(set(got))


def classified(df: DataFrame, value: str, breaks: list[float], out: str = "bin") -> DataFrame:
    """df with out (1..n, right-closed, lowest included) and out_label; one limit gives one class."""
    if not breaks:
        return df.withColumns({out: F.lit(None).cast("int"), f"{out}_label": F.lit(None).cast("string")})
    v, tops = F.col(value).cast("double"), breaks[1:] or breaks
    expr, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i in range(len(tops), 0, -1):
        low = breaks[i - 1]
        name = f"{'[' if i == 1 else '('}{low:.3g},{tops[i - 1]:.3g}]"
        inside = v <= tops[i - 1]
        expr, label = F.when(inside, F.lit(i)).otherwise(expr), F.when(inside, F.lit(name)).otherwise(label)
    fine = v.isNotNull() & ~F.isnan(v) & (v >= breaks[0])
    return df.withColumns({out: F.when(fine, expr).cast("int"), f"{out}_label": F.when(fine, label)})


def world_map(df: DataFrame, fill: str, style: str = "continuous", n_bins: int = 5) -> DataFrame:
    """df ready to fill: classes for quantile and jenks styles, else as it is."""
    one_of("style", style, ("continuous", "discrete", "quantile", "equal", "jenks"))
    need_columns(df, fill)
    return classified(df, fill, compute_breaks(df, fill, style, n_bins)) if style in ("quantile", "equal", "jenks") else df


def bivariate_classes(df: DataFrame, x: str, y: str, dim: int = 3, out: str = "class") -> DataFrame:
    """df with "i-j", the quantile classes of two variables."""
    a, b = free_names(df, "class_x", "class_y")
    work = classified(df, x, compute_breaks(df, x, "quantile", dim), a)
    work = classified(work, y, compute_breaks(df, y, "quantile", dim), b)
    code = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws("-", a, b))
    return work.withColumn(out, code).select(*dict.fromkeys([*df.columns, out]))


def bubble_points(df: DataFrame, size: str, centroids: DataFrame) -> DataFrame:
    """One row per country with its centroid (left join)."""
    one = keep_first(df, ["iso3c"], [F.col(f"`{c}`") for c in df.columns])
    return spine_join(one, centroids, "left")


def spike_triangles(df: DataFrame, height: str, centroids: DataFrame, max_height: float = 20.0, width: float = 1.6) -> DataFrame:
    """(iso3c, ord, x, y): three corners of each country's spike."""
    one = keep_first(df, ["iso3c"], [F.col(f"`{c}`") for c in df.columns]).select("iso3c", F.col(height).cast("double").alias("v"))
    at = one.join(centroids.select("iso3c", "lon", "lat"), "iso3c").where("v >= 0 and not isnan(v) and v < double('Infinity')")
    top = at.agg(F.max("v").alias("_top"))
    h = F.coalesce(F.try_divide(F.col("v"), F.col("_top")), F.lit(0.0)) * max_height
    corners = F.array(*[F.struct(F.lit(i).alias("ord"), (F.col("lon") + dx).alias("x"), (F.col("lat") + (h if up else F.lit(0.0))).alias("y")) for i, dx, up in ((1, -width / 2, False), (2, 0.0, True), (3, width / 2, False))])
    return at.crossJoin(F.broadcast(top)).select("iso3c", F.explode(corners).alias("c")).select("iso3c", "c.ord", "c.x", "c.y")


def flow_arcs(df: DataFrame, origin: str, destination: str, centroids: DataFrame, weight: str | None = None, scheme: str = "country.name", n: int = 50) -> DataFrame:
    """(flow_id, iso3c_from, iso3c_to, weight, ord, lon, lat): n points for each flow
    whose two ends resolve. flow_id is a hash of the row's ends and weight."""
    need_columns(df, origin, destination, weight)
    rows = df.select(F.col(origin).alias("a"), F.col(destination).alias("b"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    rows = resolved(resolved(rows, "a", "iso3c_from", scheme), "b", "iso3c_to", scheme)
    for side in ("from", "to"):
        rows = rows.join(F.broadcast(centroids.select(F.col("iso3c").alias(f"iso3c_{side}"), F.col("lon").alias(f"lon_{side}"), F.col("lat").alias(f"lat_{side}"))), f"iso3c_{side}")
    arc = great_circle(F.col("lon_from"), F.col("lat_from"), F.col("lon_to"), F.col("lat_to"), n)
    return rows.where("weight is not null").withColumn("p", F.explode(arc)).select(F.xxhash64("a", "b", "weight").alias("flow_id"), "iso3c_from", "iso3c_to", "weight", "p.ord", "p.lon", "p.lat")


def world_tiles(centroids: list[tuple], columns: int = 40, lines: int = 24) -> list[tuple]:
    """[(iso3c, row, col)] of a tile grid from some hundreds of (iso3c, lon, lat).

    Equal-width cells; by falling |latitude| each takes the first free cell of
    growing squares around its own. Sequential by nature, so on the driver.
    """
    fine = [c for c in centroids if c[1] is not None and c[2] is not None]
    if not fine:
        return []

    def cell(v, values, n):
        lo, hi = min(values), max(values)
        return 1 if hi == lo else min(n, max(1, -int(-(v - lo) / (hi - lo) * n // 1)))

    lons, tops = [c[1] for c in fine], [-c[2] for c in fine]
    taken, out = set(), []
    for code, lon, lat in sorted(fine, key=lambda c: (-abs(c[2]), c[0])):
        r, c = cell(-lat, tops, lines), cell(lon, lons, columns)
        spot = next(((r + dr, c + dc) for radius in range(9) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if r + dr >= 1 and c + dc >= 1 and (r + dr, c + dc) not in taken), None)
        if spot:
            taken.add(spot)
            out.append((code, *spot))
    return sorted(out, key=lambda t: t[1:])


def tile_map(df: DataFrame, tiles: DataFrame) -> DataFrame:
    """All tiles with df's columns: tiles LEFT JOIN df."""
    return spine_join(tiles, df, "left")


def label_points(df: DataFrame, flags: bool = False) -> DataFrame:
    """(iso3c, lon, lat[, flag]): where country labels go."""
    from .resolve import with_attributes
    from .spatial import bbox_centroids, polygon_centroids

    at = polygon_centroids(df) if {"group", "order"} <= set(df.columns) else bbox_centroids(df)
    return with_attributes(at, ("flag",)) if flags else at


def globe_view(df: DataFrame, lon: float = 0.0, lat: float = 0.0) -> DataFrame:
    """df (long, lat) with orthographic x, y and visible."""
    p = project(F.col("long"), F.col("lat"), "orthographic", lon, lat)
    return df.withColumns({n: p[n] for n in ("x", "y", "visible")})


def globe_map(data: DataFrame, frame: DataFrame, fill: str, lon: float = 0.0, lat: float = 0.0, style: str = "continuous", n_bins: int = 5, clip: bool = False) -> DataFrame:
    """frame with data's columns, classes of fill where a style asks for them, and
    its place on the globe seen from (lon, lat). With clip, rings are cut at the
    limb (clip_globe), so that all that is left is visible."""
    from .globe import clip_globe
    from .joins import attach_geometry

    shown = clip_globe(frame, lon, lat) if clip else frame
    return globe_view(attach_geometry(world_map(data, fill, style, n_bins), shown), lon, lat)


def cartogram_map(df: DataFrame, weight: str, frame: DataFrame, kind: str = "contiguous", rounds: int = 8) -> DataFrame:
    """frame with areas by weight: deformed as a whole, or each country scaled by itself."""
    from .cartogram import contiguous_cartogram

    if one_of("kind", kind, ("contiguous", "noncontiguous")) == "contiguous":
        return contiguous_cartogram(df, weight, frame, rounds)[0]
    return cartogram_scale(df, weight, frame)


def dorling_map(df: DataFrame, weight: str, centroids: DataFrame, k: float = 5.0, rounds: int = 1000) -> DataFrame:
    """(iso3c, lon, lat, r): a circle per country around its centroid, of area by weight, none overlapping."""
    from .dorling import dorling_layout

    need_columns(df, "iso3c", weight)
    at = df.select("iso3c", F.col(weight).alias("_w")).join(centroids.select("iso3c", "lon", "lat"), "iso3c")
    return dorling_layout(at, "_w", k=k, rounds=rounds)


def globe_frames(n_frames: int = 60) -> list[float]:
    """Central longitudes of a turning globe: equal steps, 360 left out."""
    n = max(2, int(n_frames))
    return [360.0 * i / n for i in range(n)]


def frame_values(df: DataFrame, column: str = "year") -> list:
    """Distinct frames (animation) or facets of a table, in order."""
    need_columns(df, column)
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def dorling(points: list[tuple], k: float = 5.0, rounds: int = 1000) -> list[tuple]:
    """[(key, x, y, r)]: circles of area by weight pushed apart, from a few
    (key, x, y, weight) at hand on the driver; tables take dorling_map."""
    live = [[key, float(x), float(y), float(w)] for key, x, y, w in points if w is not None and w > 0]
    if not live:
        raise SpineError("no positive weights")
    top = max(p[3] for p in live)
    out = [[key, x, y, k * (w / top) ** 0.5] for key, x, y, w in live]
    for _ in range(rounds):
        moved = False
        for i, a in enumerate(out):
            for b in out[:i]:
                dx, dy = a[1] - b[1], a[2] - b[2]
                d, need = (dx * dx + dy * dy) ** 0.5, a[3] + b[3]
                if d < need - 1e-6:
                    ux, uy, s = (dx / d, dy / d, (need - d) / 2) if d > 0 else (1.0, 0.0, need / 2)
                    a[1], a[2], b[1], b[2] = a[1] + ux * s, a[2] + uy * s, b[1] - ux * s, b[2] - uy * s
                    moved = True
        if not moved:
            break
    return [tuple(p) for p in out]


def cartogram_scale(df: DataFrame, weight: str, frame: DataFrame) -> DataFrame:
    """frame with vertices scaled about their country's centroid so that its area
    follows the weight (non-contiguous cartogram); weights not above 0 drop out."""
    from .spatial import country_areas, polygon_centroids

    w = df.select("iso3c", F.col(weight).cast("double").alias("_w")).where("_w > 0").groupBy("iso3c").agg(F.max("_w").alias("_w"))
    per = w.join(country_areas(frame), "iso3c").join(polygon_centroids(frame).toDF("iso3c", "_lon", "_lat"), "iso3c").where("area_km2 > 0")
    best = per.agg(F.max(F.col("_w") / F.col("area_km2")).alias("_best"))
    s = per.crossJoin(F.broadcast(best)).select("iso3c", "_lon", "_lat", F.sqrt(F.col("_w") / F.col("area_km2") / F.col("_best")).alias("_s"))
    moved = {"long": F.col("_lon") + (F.col("long") - F.col("_lon")) * F.col("_s"), "lat": F.col("_lat") + (F.col("lat") - F.col("_lat")) * F.col("_s")}
    joined = frame.join(F.broadcast(s), "iso3c")
    return joined.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in frame.columns])


def map_distance(df: DataFrame, lon: str, lat: str, to_lon: float, to_lat: float, out: str = "km") -> DataFrame:
    return df.withColumn(out, haversine_km(F.col(lon), F.col(lat), F.lit(to_lon), F.lit(to_lat)))


def chart_spec(data_url: str, fill: str, title: str | None = None, projection: str = "equalEarth", palette: str = "viridis", na_label: str = "No data", borders: bool = True, facet: str | None = None, tooltip: list | None = None) -> str:
    """A Vega-Lite choropleth specification over prepared data."""
    spec = {
        "$schema": "https://vega.github.io/schema/vega-lite/v5.json",
        "data": {"url": data_url},
        "projection": {"type": projection},
        "mark": {"type": "geoshape", **({"stroke": "white", "strokeWidth": 0.2} if borders else {})},
        "encoding": {
            "color": {"field": fill, "type": "quantitative", "scale": {"scheme": palette}, "legend": {"title": title or fill, "labelExpr": f"isValid(datum.value) ? datum.label : '{na_label}'"}},
            **({"tooltip": [{"field": t} for t in tooltip]} if tooltip else {}),
            **({"facet": {"field": facet}} if facet else {}),
        },
    }
    return json.dumps(spec | ({"title": title} if title else {}), indent=2)


def theme(base_size: int = 11, base_family: str = "") -> dict:
    """Chart configuration without axes or grid."""
    return {"font": base_family or "sans-serif", "axis": {"disable": True}, "view": {"stroke": None}, "legend": {"labelFontSize": base_size - 2, "titleFontSize": base_size}, "title": {"fontSize": base_size + 3}}
