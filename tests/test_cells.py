"""Many outlines over each other: against counts on a grid, and how much of them reaches the sweep."""

import random

import numpy as np
import pytest

from isospan.operators import cells, overlay
from test_overlay import box, frame_of, rings_of, signed_area


def covered(boxes, n):
    out = np.zeros((n, n), bool)
    for x0, y0, x1, y1 in boxes:
        out[x0:x1, y0:y1] = True
    return out


def some_boxes(rng, count, n, least, most):
    made = []
    for _ in range(count):
        w, h = rng.randint(least, most), rng.randint(least, most)
        x, y = rng.randint(0, n - w), rng.randint(0, n - h)
        made.append((x, y, x + w, y + h))
    return made


def perimeter(grid):
    g = np.pad(grid, 1).astype(int)
    return np.abs(np.diff(g, axis=0)).sum() + np.abs(np.diff(g, axis=1)).sum()


def around(rings):
    return sum(abs(q[0] - p[0]) + abs(q[1] - p[1]) for r in rings for p, q in zip(r, r[1:] + r[:1]))


def test_only_edges_along_the_outline_reach_the_sweep():
    rng = random.Random(4)
    boxes = some_boxes(rng, 3000, 200, 12, 40)
    x0, y0, x1, y1 = (np.array(v, float) for v in zip(*[e for a, b, c, d in boxes for e in ((a, b, c, b), (a, d, c, d), (a, b, a, d), (c, b, c, d))]))
    owner, k = np.repeat(np.arange(3000), 4), np.arange(12000)
    args = x0, y0, x1, y1, owner, np.zeros(12000, bool)
    sides = ([-1.3], [-1.4], [201.3], [201.4])
    swept = sum(len(rows[1]) for _, rows, _ in cells.outline_cells(*args, np.zeros(12000, int), sides, None))
    segments = cells.strip_outlines(*args, (np.zeros(12000, int), k), sides, None)[0]
    want = covered(boxes, 200)
    assert swept < 6000  # each of 6,000 sides in each of some 370 slabs it spans before
    assert sum((p[0] * q[1] - q[0] * p[1]) / 2 for _, _, p, q in segments) == pytest.approx(want.sum())
    assert sum(abs(q[0] - p[0]) + abs(q[1] - p[1]) for _, _, p, q in segments) == pytest.approx(perimeter(want))


@pytest.mark.parametrize("strip_edges", [60, None])
def test_outlines_over_each_other_against_a_grid(spark, strip_edges):
    rng = random.Random(11)
    own = {kind: some_boxes(rng, 150, 60, 4, 18) for kind in "ab"}
    masks = some_boxes(rng, 25, 60, 3, 20)
    turned = lambda b: [(x + y, x - y) for x, y in box(*b)]  # noqa: E731  sides at 45 degrees, many on one line
    for turn, size in ((lambda b: box(*b), 1), (turned, 2)):
        frame = frame_of(spark, [(f"{k}{i}", k, [turn(b)]) for k, bs in own.items() for i, b in enumerate(bs)])
        mask = frame_of(spark, [(f"m{i}", "m", [turn(b)]) for i, b in enumerate(masks)])
        hidden = covered(masks, 60)
        for how in ("union", "intersection", "difference"):
            got = rings_of(overlay.overlay(frame, "kind", None if how == "union" else mask, how, strip_edges=strip_edges), "kind")
            for k, bs in own.items():
                want = covered(bs, 60)
                want = want if how == "union" else want & (hidden if how == "intersection" else ~hidden)
                assert sum(map(signed_area, got[k])) == pytest.approx(size * want.sum())
                assert around(got[k]) == pytest.approx(size * perimeter(want))


def test_ends_on_a_strip_border_meet_in_spite_of_rounding():
    after = overlay.followed([1, 2, 3], [5.0, 5.0, 9.0], [1.0 + 4e-15, 2.0, 7.0], [9.0, 9.0, 5.0], [7.0, 8.0, 1.0])
    assert after == {1: 3, 2: None, 3: 1}


def test_long_edges_and_many_results(spark, monkeypatch):
    """Strips that edges reach across are fewer, and results are dealt in bundles."""
    monkeypatch.setattr(overlay, "STRIP_EDGES", 30)
    rng = random.Random(2)
    own = {f"r{k}": some_boxes(rng, 12, 40, 4, 25) for k in range(30)}
    frame = frame_of(spark, [(f"{k}-{i}", k, [box(*b)]) for k, bs in own.items() for i, b in enumerate(bs)])
    dealt = []
    made = overlay.cut
    monkeypatch.setattr(overlay, "cut", lambda df: dealt.append(made(df)) or dealt[-1])
    got = rings_of(overlay.union_outlines(frame, "kind"), "kind")
    first = {r[0] for r in dealt[1].select("part").collect()}
    assert len({p >> 32 for p in first}) < 100 and len(dealt) == 2
    for k, bs in own.items():
        want = covered(bs, 40)
        assert sum(map(signed_area, got[k])) == pytest.approx(want.sum()) and around(got[k]) == pytest.approx(perimeter(want))
