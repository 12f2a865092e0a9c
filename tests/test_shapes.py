import random

import pytest

from isospan.operators import cartogram, nesting
from isospan.sinks.export import polygon_wkb, wkb_frame
from test_overlay import box, frame_of, rings_of, signed_area


def test_forest_of_rings(spark):
    rings = [box(0, 0, 20, 20), box(1, 1, 9, 9)[::-1], box(2, 2, 8, 8), box(10, 10, 12, 12), box(3, 3, 4, 4), box(30, 0, 31, 1), box(12, 12, 14, 14), box(0, 0, 1, 1)]
    frame = frame_of(spark, [("LSO", "x", rings), ("ZAF", "x", [box(-5, -5, 25, 25)])])
    got = {r["group"]: (r["depth"], r["parent"]) for r in nesting.nested_rings(frame, cell=3.0).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (2, 2), 4: (1, 1), 5: (3, 3), 6: (0, None), 7: (1, 1), 8: (1, 1), 9: (0, None)}
    parts = {r["iso3c"]: r["parts"] for r in nesting.polygons(frame).collect()}
    turned = [[round(signed_area([(p["lon"], p["lat"]) for p in ring])) for ring in part] for part in parts["LSO"]]
    assert turned == [[400, -64, -4, -4, -1], [36, -1], [1]]


def test_a_square_with_a_hole_is_one_polygon(spark):
    import struct

    frame = frame_of(spark, [("LSO", "x", [box(0, 0, 4, 4), box(1, 1, 3, 3)])])
    raw = bytes(wkb_frame(frame).first()["geometry"])
    assert struct.unpack_from("<BII", raw) == (1, 6, 1) and struct.unpack_from("<BIII", raw, 9) == (1, 3, 2, 5)
    assert raw == polygon_wkb([[box(0, 0, 4, 4), [(1, 1), (1, 3), (3, 3), (3, 1)][::1]]]) or len(raw) == 9 + 9 + 2 * 84


def test_degenerate_rings(spark):
    frame = frame_of(spark, [("A", "x", [[(0, 0)], [(0, 0), (1, 1)], [(0, 0), (1, 0), (2, 0)]]), (None, "x", [box(0, 0, 1, 1)])])
    assert sorted((r["group"], r["depth"]) for r in nesting.nested_rings(frame).collect()) == [(1, 0), (2, 0), (3, 0)]
    assert nesting.nested_rings(frame.limit(0)).count() == 0


def mesh(n, jitter=0.0, seed=2):
    rng = random.Random(seed)
    at = {(i, j): (i + jitter * rng.uniform(-1, 1), j + jitter * rng.uniform(-1, 1)) for i in range(n + 1) for j in range(n + 1)}
    return [(f"{chr(65 + i)}{j}", "x", [[at[i, j], at[i + 1, j], at[i + 1, j + 1], at[i, j + 1], at[i, j]]]) for i in range(n) for j in range(n)], at


def crossing(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def test_cartogram_keeps_the_mesh_and_nears_the_weights(spark):
    shapes, at = mesh(5, 0.25)
    rng = random.Random(5)
    frame = frame_of(spark, shapes)
    data = spark.createDataFrame([(c, rng.choice([1.0, 2.0, 5.0, 9.0])) for c, *_ in shapes], "iso3c string, w double")
    out, errors = cartogram.contiguous_cartogram(data, "w", frame, 8)
    assert all(b < a for a, b in zip(errors, errors[1:])) and errors[-1] < 1 + (errors[0] - 1) * 0.35
    before = {(r["group"], r["order"]): (r["long"], r["lat"]) for r in frame.collect()}
    after = {(r["group"], r["order"]): (r["long"], r["lat"]) for r in out.collect()}
    assert set(before) == set(after) and out.columns == frame.columns
    moved = {}
    for k, p in before.items():
        moved.setdefault(p, set()).add(after[k])
    assert all(len(v) == 1 for v in moved.values()) and len({p for v in moved.values() for p in v}) == len(at)
    edges = {tuple(sorted((after[g, o], after[g, o + 1]))) for g, o in after if (g, o + 1) in after}
    edges = sorted(edges)
    assert not any(crossing(*a, *b) for i, a in enumerate(edges) for b in edges[:i])


def test_cartogram_drops_countries_without_weight(spark):
    frame = frame_of(spark, [("A", "x", [box(0, 0, 4, 4), box(1, 1, 3, 3)]), ("B", "x", [box(4, 0, 8, 4)]), ("C", "x", [box(8, 0, 9, 1)])])
    data = spark.createDataFrame([("A", 1.0), ("A", None), ("B", 2.0), ("C", 0.0), (None, 3.0), ("D", 1.0), ("B", float("nan"))], "iso3c string, w double")
    out, errors = cartogram.contiguous_cartogram(data, "w", frame, 20)
    rings = rings_of(out, "iso3c")
    assert set(rings) == {"A", "B"} and errors[-1] < errors[0]
    a = abs(signed_area(rings["A"][0])) - abs(signed_area(rings["A"][1]))
    assert abs(signed_area(rings["B"][0])) / a == pytest.approx(2.0, rel=0.15)
