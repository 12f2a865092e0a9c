"""Dissolved meshes, chained in tiles: against edges counted by hand, at any size of tile."""

import random
import time

import pytest

from isospan.operators import spatial
from test_overlay import box, frame_of, rings_of, signed_area


def patches(rng, n, kinds):
    return {(i, j): rng.choice(kinds) for i in range(n) for j in range(n)}


def outline(cells, kind):
    edges = {}
    for (i, j), k in cells.items():
        if k == kind:
            ring = box(i, j, i + 1, j + 1)
            for p, q in zip(ring, ring[1:] + ring[:1]):
                if (q, p) in edges:
                    del edges[q, p]
                else:
                    edges[p, q] = 1
    return set(edges)


@pytest.mark.parametrize("tile_edges", [6, 40, 100_000])
def test_rings_in_tiles(spark, tile_edges):
    cells = patches(random.Random(3), 12, "abc")
    frame = frame_of(spark, [(f"{k}{i}.{j}", k, [box(i, j, i + 1, j + 1)]) for (i, j), k in cells.items()])
    out = spatial.dissolve(frame, "kind", tile_edges=tile_edges)
    assert out.columns == ["kind", "group", "order", "long", "lat"] and dict(out.dtypes)["group"] == dict(out.dtypes)["order"] == "int"
    got = rings_of(out, "kind")
    for kind in "abc":
        want = outline(cells, kind)
        assert {e for r in got[kind] for e in zip(r, r[1:] + r[:1])} == want and sum(map(len, got[kind])) == len(want)
        assert sum(map(signed_area, got[kind])) == sum(k == kind for k in cells.values())
        assert all(r[0] == min(r) for r in got[kind]) and [r[0] for r in got[kind]] == sorted(r[0] for r in got[kind])


def test_open_ends_shared_corners_and_nulls(spark):
    shapes = [("A", "x", [box(0, 0, 1, 1)]), ("B", "x", [box(0, 0, 1, 1)[::-1]]), ("C", "x", [box(1, 1, 2, 2)]), ("D", None, [box(5, 5, 6, 6)]), ("E", "y", [box(0, 0, 1, 1)]), ("F", "y", [box(1, 0, 2, 1)[::-1]])]
    for tile_edges in (1, 1000):
        out = spatial.dissolve(frame_of(spark, shapes), "kind", tile_edges=tile_edges)
        n = {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()}
        assert n == {"x": 4, None: 4, "y": 6}  # rings that turn both ways have open ends, but all edges
    assert spatial.dissolve(frame_of(spark, shapes).limit(0), "kind").count() == 0


def test_many_rings_take_time_in_proportion():
    """20,000 squares apart: each ring began with a search through all vertices before."""
    rings = [box(3 * i, 3 * j, 3 * i + 1, 3 * j + 1) for i in range(200) for j in range(100)]
    edges = sorted((*p, *q) for r in rings for p, q in zip(r, r[1:] + r[:1]))
    began = time.time()
    found = spatial.stretches(edges, [True] * len(edges))
    assert len(found) == 20_000 and all(closed and len(path) == 4 for closed, _, _, path in found)
    assert time.time() - began < 15
