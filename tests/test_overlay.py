import math
import random

import pytest

from isospan.operators import overlay

SCHEMA = "iso3c string, `group` int, `order` int, long double, lat double, kind string"


def frame_of(spark, shapes):
    """shapes: [(iso3c, kind, [ring, ...])]."""
    rows, g = [], 0
    for code, kind, rings in shapes:
        for ring in rings:
            g += 1
            rows += [(code, g, i, float(x), float(y), kind) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, SCHEMA)


def inside(rings, x, y):
    hit = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                hit = not hit
    return hit


def signed_area(ring):
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) / 2


def rings_of(df, by):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r[by]), r["group"], r["order"])):
        out.setdefault(r[by], {}).setdefault(r["group"], []).append((r["long"], r["lat"]))
    return {k: list(v.values()) for k, v in out.items()}


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def blob(rng, cx, cy, r, n):
    return [(cx + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def raster(rng, want, got, keys, span, n=4000):
    """Points that the result and the plain rule place differently."""
    wrong = 0
    for _ in range(n):
        x, y = rng.uniform(*span), rng.uniform(*span)
        for k in keys:
            wrong += want(k, x, y) != inside(got.get(k, []), x, y)
    return wrong


@pytest.mark.parametrize("strip_edges", [25, 100_000])
@pytest.mark.parametrize("how", ["union", "intersection", "difference"])
def test_random_outlines_against_points(spark, how, strip_edges):
    rng = random.Random(8)
    shapes = [(f"C{i}", "abc"[i % 3], [blob(rng, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0.5, 3), rng.randint(3, 14))]) for i in range(24)]
    shapes[3][2].append([(x * 0.3 + 3, y * 0.3 + 3) for x, y in shapes[3][2][0]])
    masks = [(f"M{i}", "m", [blob(rng, rng.uniform(0, 10), rng.uniform(0, 10), 3, 9)]) for i in range(4)]
    frame = frame_of(spark, shapes)
    mask = None if how == "union" else frame_of(spark, masks)
    got = rings_of(overlay.overlay(frame, "kind", mask, how, strip_edges=strip_edges), "kind")

    def want(k, x, y):
        own = any(inside(r, x, y) for _, kind, r in shapes if kind == k)
        return own and (how == "union" or any(inside(r, x, y) for *_, r in masks) == (how == "intersection"))

    assert raster(rng, want, got, "abc", (-2, 12)) == 0
    assert all(len(set(r)) == len(r) and len(r) > 2 for rings in got.values() for r in rings)


@pytest.mark.parametrize("strip_edges", [5, 100_000])
def test_shared_edges_corners_holes_and_parts(spark, strip_edges):
    shapes = [
        ("A", "mesh", [box(0, 0, 1, 1)]), ("B", "mesh", [box(1, 0, 2, 1)]), ("C", "mesh", [box(0, 1, 2, 2)]),  # share whole and part edges
        ("D", "corner", [box(0, 0, 1, 1)]), ("E", "corner", [box(1, 1, 2, 2)]),  # touch in a point
        ("F", "frame", [box(0, 0, 3, 1)]), ("G", "frame", [box(0, 2, 3, 3)]), ("H", "frame", [box(0, 0, 1, 3)]), ("I", "frame", [box(2, 0, 3, 3)]),  # enclose a hole
        ("J", "apart", [box(5, 5, 6, 6)]), ("K", "apart", [box(7, 5, 8, 6)]), ("L", "same", [box(0, 0, 1, 1)]), ("M", "same", [box(0, 0, 1, 1)]),
        ("N", "holed", [box(0, 0, 4, 4), box(1, 1, 3, 3)]), ("O", "holed", [box(2, 2, 5, 5)]),
    ]
    got = rings_of(overlay.union_outlines(frame_of(spark, shapes), "kind", strip_edges=strip_edges), "kind")
    areas = {k: sorted(round(signed_area(r), 6) for r in v) for k, v in got.items()}
    assert areas == {"mesh": [4.0], "corner": [1.0, 1.0], "frame": [-1.0, 9.0], "apart": [1.0, 1.0], "same": [1.0], "holed": [-3.0, 21.0]}
    assert {p for r in got["frame"] for p in r} >= {(0, 0), (3, 0), (3, 3), (0, 3), (1, 1), (2, 1), (2, 2), (1, 2)}


def test_parts_of_a_clip_have_no_bridges(spark):
    comb = [(0, 0), (7, 0), (7, 5), (6, 5), (6, 1), (4, 1), (4, 5), (3, 5), (3, 1), (1, 1), (1, 5), (0, 5)]
    out = rings_of(overlay.clip_outlines(frame_of(spark, [("A", "x", [comb])]), frame_of(spark, [("M", "m", [box(-1, 2, 9, 9)])])), "iso3c")["A"]
    assert sorted(sorted(r) for r in out) == [sorted(box(x, 2, x + 1, 5)) for x in (0, 3, 6)]
    gone = overlay.erase_outlines(frame_of(spark, [("A", "x", [comb])]), frame_of(spark, [("M", "m", [box(-1, -1, 9, 9)])]))
    assert gone.count() == 0


def test_rows_without_codes(spark):
    frame = frame_of(spark, [("A", None, [box(0, 0, 1, 1)]), (None, "x", [box(0, 0, 1, 1)]), ("B", "x", [box(4, 4, 5, 5)])])
    assert set(rings_of(overlay.union_outlines(frame, "kind"), "kind")) == {"x"}
    assert overlay.union_outlines(frame.limit(0), "kind").count() == 0
