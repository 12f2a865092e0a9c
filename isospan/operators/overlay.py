"""Union, intersection and difference of arbitrary outlines.

The plane is cut into vertical strips of about as many edges each, a task's work;
strip borders lie between the grid points that vertices are rounded to. A strip is
halved into cells (cells.py), of which those without an outline go early. In a
cell every vertex and crossing is a breakpoint, between which edges keep their
order, so that walking up each slab tells where the result's inside begins and
ends. Upright sides are where the insides to both sides of a breakpoint differ.
What leaves a strip are stretches of outline; only their ends, those on strip
borders, meet to be put together into rings.

Outlines run with their inside on the left: holes turn the other way round.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import need_columns, one_of
from ..shared import cut
from .cells import X_OFF, Y_OFF, border, closed_up, strip_outlines
from .spatial import TASKS, place_among, ring_edges

DIGITS = 9
STRIP_EDGES = 10_000
JOIN = 1e-7  # how far ends on a strip border may differ by rounding
STRIPS_AN_EDGE = 2  # strips that an edge reaches beyond its first, on average, at most


def _turn(p, q, r) -> float:
    """Angle from going p -> q to going q -> r, left being positive."""
    ax, ay, bx, by = q[0] - p[0], q[1] - p[1], r[0] - q[0], r[1] - q[1]
    return float(np.arctan2(ax * by - ay * bx, ax * bx + ay * by))


def chained(segments) -> list[tuple]:
    """[(out, closed, [points])] from directed segments of one strip.

    Where outlines touch, the sharpest left turn is taken, so that rings part
    there. Points within one straight edge are dropped.
    """
    after = defaultdict(list)
    for i, (out, _, a, _) in enumerate(segments):
        after[out, a].append(i)
    followed, next_of = set(), {}
    into = defaultdict(list)
    for i, (out, _, _, b) in enumerate(segments):
        into[out, b].append(i)
    for node, ins in into.items():
        outs = list(after.get(node, ()))
        pairs = sorted(((-_turn(segments[i][2], segments[i][3], segments[o][3]), i, o) for i in ins for o in outs)) if len(ins) > 1 or len(outs) > 1 else [(0, ins[0], outs[0])] if outs else []
        used = set()
        for _, i, o in pairs:
            if i not in next_of and o not in used:
                next_of[i] = o
                used.add(o)
                followed.add(o)
    done, out = set(), []

    def walk(i):
        path = []
        while i is not None and i not in done:
            done.add(i)
            path.append(i)
            i = next_of.get(i)
        return path

    def points(path, closed):
        got = [] if closed else [segments[path[0]][2]]
        for i, j in zip(path, path[1:] + path[:1] if closed else path[1:]):
            if segments[i][1] != segments[j][1]:
                got.append(segments[i][3])
        return got if closed else [*got, segments[path[-1]][3]]

    for i in range(len(segments)):
        if i not in followed and i not in done:
            path = walk(i)
            out.append((segments[i][0], False, points(path, False)))
    for i in range(len(segments)):
        if i not in done:
            path = walk(i)
            out.append((segments[i][0], True, points(path, True)))
    return out


def followed(part, sx, sy, ex, ey) -> dict:
    """{stretch: the one that goes on from its end, or None}; ends on one strip border.

    Where sides of several outlines lie on each other, the strips on both sides of
    a border may take their heights from different ones, which differ by rounding.
    """
    start, after = defaultdict(list), dict.fromkeys(part)
    for x, y, p in sorted(zip(sx, sy, part)):
        start[x].append([y, p, False])
    rest = []
    for x, y, p in sorted(zip(ex, ey, part)):
        here = start[x]
        k = bisect_left(here, y, key=lambda h: h[0])
        while k < len(here) and here[k][2] and here[k][0] == y:
            k += 1
        if k < len(here) and here[k][0] == y:
            after[p], here[k][2] = here[k][1], True
        else:
            rest.append((x, y, p))
    free = {x: [h for h in start[x] if not h[2]] for x in {r[0] for r in rest}}
    for x, y, p in rest:
        k = bisect_left(free[x], y, key=lambda h: h[0])
        near = [j for j in (k - 1, k) if 0 <= j < len(free[x]) and abs(free[x][j][0] - y) < JOIN]
        if near:
            after[p] = free[x].pop(min(near, key=lambda j: abs(free[x][j][0] - y)))[1]
    return after


_PARTS = "out string, part long, closed boolean, points array<struct<x: double, y: double>>"


def overlay(frame: DataFrame, by: str = "iso3c", mask: DataFrame | None = None, how: str = "union", strip_edges: int | None = None) -> DataFrame:
    """(by, group, order, long, lat): outlines of each value of by.

    A country's inside is even-odd over its rings, so holes count out. union: the
    union of the countries of each value of by; with a mask, `intersection` is
    that inside any outline of the mask, `difference` that outside all of them.
    Rings are numbered within a value, don't repeat their first vertex, and have
    the inside on their left. Coordinates are rounded to nine digits. Rows
    without a code or a value of by, and empty results, give no rows.
    """
    need_columns(frame, "iso3c", by)
    one_of("how", how, ("union", "intersection", "difference") if mask is not None else ("union",))
    keep = {"union": None, "intersection": True, "difference": False}[how]

    def flat(df, key, is_mask):
        at = lambda c: (F.round(F.col(f"{c}.x"), DIGITS), F.round(F.col(f"{c}.y"), DIGITS))
        (px, py), (qx, qy) = at("p"), at("q")
        ahead = (px < qx) | ((px == qx) & (py < qy))
        pick = lambda a, b: F.when(ahead, a).otherwise(b)
        cols = [pick(px, qx).alias("x0"), pick(py, qy).alias("y0"), pick(qx, px).alias("x1"), pick(qy, py).alias("y1")]
        return df.select(key.cast("string").alias("out"), F.concat(F.lit("m" if is_mask else "a"), "iso3c").alias("owner"), F.lit(is_mask).alias("mask"), *cols).where("(x0 < x1 or y0 < y1) and out is not null")

    coded = frame.where("iso3c is not null")
    edges = ring_edges(coded)
    if by != "iso3c":
        edges = edges.join(coded.select(F.col("group").alias("_g"), F.col(by).alias("_by")).distinct(), F.col("group") == F.col("_g"))
    edges = flat(edges, F.col("_by" if by != "iso3c" else "iso3c"), False)
    if by != "iso3c":  # a country may have several values of by
        edges = edges.withColumn("owner", F.concat("owner", F.lit("|"), "out"))
    if mask is not None:  # as one outline, so that its parts don't cross each other for every result
        whole = overlay(mask.where("iso3c is not null").select("iso3c", "group", "order", "long", "lat", F.lit("m").alias("_all")), "_all", strip_edges=strip_edges)
        edges = edges.unionByName(flat(ring_edges(whole.withColumnRenamed("_all", "iso3c")), F.lit(""), True))
    edges = cut(edges)
    strips = max(1, -(-edges.count() // (strip_edges or STRIP_EDGES)))
    spots = edges.agg(F.percentile_approx("x0", [i / strips for i in range(1, strips)], 10 * strips).alias("c")).first()["c"] if strips > 1 else []
    cuts = sorted({float(border(c, X_OFF)) for c in spots or []})
    bundles = 1
    if cuts and strip_edges is None:  # long edges: fewer strips, each by results in bundles
        reach = edges.where("not mask").agg(F.avg(place_among(F.col("x1"), cuts) - place_among(F.col("x0"), cuts)), F.count(F.lit(1))).first()
        step = max(1, math.ceil((reach[0] or 0) / STRIPS_AN_EDGE))
        cuts = cuts[step // 2 :: step]
        bundles = max(1, math.ceil(reach[1] * (1 + (reach[0] or 0) / step) / (len(cuts) + 1) / (4 * STRIP_EDGES)))
    bounds = [-np.inf, *cuts, np.inf]
    dealt = edges.withColumn("strip", F.explode(F.sequence(place_among(F.col("x0"), cuts), place_among(F.col("x1"), cuts))))
    bundle = F.pmod(F.xxhash64("out"), F.lit(bundles)).cast("int")
    if mask is None:
        dealt = dealt.withColumn("bundle", bundle)
    else:  # the mask meets every bundle
        every = F.sequence(F.lit(0), F.lit(bundles - 1))
        dealt = dealt.withColumn("bundle", F.explode(F.when(F.col("mask"), every).otherwise(F.array(bundle))))

    def worked(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["x0", "y0", "x1", "y1", "owner", "out"], kind="stable")
        s = int(pdf["strip"].iloc[0])
        x0, y0, x1, y1 = (pdf[c].to_numpy(np.float64) for c in ("x0", "y0", "x1", "y1"))
        masks = pdf["mask"].to_numpy(bool)
        own = np.flatnonzero(~masks)
        result, names = pd.factorize(pdf["out"].to_numpy(object)[own], sort=True)
        owner = pd.factorize(pdf["owner"])[0]
        most = lambda f, v, n=len(names): pd.Series(v).groupby(result).agg(f).to_numpy(np.float64)
        low, high = np.minimum(y0, y1), np.maximum(y0, y1)
        if not len(own):
            return pd.DataFrame([], columns=["out", "part", "closed", "points"])
        left = np.maximum(bounds[s], border(most("min", x0[own]) - 1, X_OFF))
        right = np.minimum(bounds[s + 1], border(most("max", x1[own]) + 1, X_OFF))
        top = border(most("max", high[own]) + 1, Y_OFF)
        bottom = np.full(len(names), border(low.min() - 1, Y_OFF))
        root, number = [result], [own]
        for i in range(len(names) if masks.any() else 0):  # those of the mask beside or below a result
            k = np.flatnonzero(masks & (x1 > left[i]) & (x0 < right[i]) & (low < top[i]))
            root.append(np.full(len(k), i))
            number.append(k)
        root, k = np.concatenate(root), np.concatenate(number)
        found = strip_outlines(x0[k], y0[k], x1[k], y1[k], owner[k], masks[k], (root, k), (left, bottom, right, top), keep)
        parts = [p for i in sorted(found) for p in chained(closed_up(found[i], bounds[s], bounds[s + 1]))]
        first = (s * bundles + int(pdf["bundle"].iloc[0])) << 32
        rows = [(names[i], first + n, closed, [{"x": x, "y": y} for x, y in points]) for n, (i, closed, points) in enumerate(parts) if len(points) > 1]
        return pd.DataFrame(rows, columns=["out", "part", "closed", "points"])

    # a number of its own: few bytes are much work here, and would be put together in one task
    dealt = dealt.repartition(min(TASKS, (len(cuts) + 1) * bundles), "strip", "bundle")
    parts = cut(dealt.groupBy("strip", "bundle").applyInPandas(worked, _PARTS))

    def joined(pdf):
        import pandas as pd

        after = followed(*(pdf[c].tolist() for c in ("part", "sx", "sy", "ex", "ey")))
        rows, done = [], set()
        for first in sorted(after):
            seq, here = 0, first
            while here is not None and here not in done:
                done.add(here)
                rows.append((pdf["out"].iloc[0], here, first, seq))
                seq, here = seq + 1, after[here]
        return pd.DataFrame(rows, columns=["out", "part", "ring", "seq"])

    ends = parts.where("not closed").select("out", "part", F.col("points")[0]["x"].alias("sx"), F.col("points")[0]["y"].alias("sy"), F.element_at("points", -1)["x"].alias("ex"), F.element_at("points", -1)["y"].alias("ey"))
    placed = ends.groupBy("out").applyInPandas(joined, "out string, part long, ring long, seq int")
    rings = parts.where("closed").select("out", F.col("part").alias("ring"), F.lit(0).alias("seq"), "points").unionByName(parts.where("not closed").join(placed, ["out", "part"]).select("out", "ring", "seq", F.slice("points", 1, F.size("points") - 1).alias("points")))
    flat_points = rings.select("out", "ring", "seq", F.posexplode("points").alias("i", "p"))
    # the joint of two stretches of one edge is no vertex: it lies between grid points
    inner = flat_points.where(~((F.col("i") == 0) & F.col("p.x").isin(cuts))) if cuts else flat_points
    kind = frame.schema[by].dataType
    numbered = inner.select(F.col("out").cast(kind).alias(by), "ring", (F.dense_rank().over(Window.partitionBy("out").orderBy("ring"))).alias("group"), F.row_number().over(Window.partitionBy("out", "ring").orderBy("seq", "i")).alias("order"), F.col("p.x").alias("long"), F.col("p.y").alias("lat"))
    return numbered.select(by, "group", "order", "long", "lat")


def union_outlines(frame: DataFrame, by: str, **options) -> DataFrame:
    """overlay of the countries of each value of by: their union."""
    return overlay(frame, by, **options)


def clip_outlines(frame: DataFrame, mask: DataFrame, by: str = "iso3c", **options) -> DataFrame:
    """What of each country lies inside the mask; parts stay apart, without edges between them."""
    return overlay(frame, by, mask, "intersection", **options)


def erase_outlines(frame: DataFrame, mask: DataFrame, by: str = "iso3c", **options) -> DataFrame:
    """What of each country lies outside the mask."""
    return overlay(frame, by, mask, "difference", **options)
