"""Rounds of circles in tiles: those of one task, whatever the tiles, borders and steps."""

import math
import random

import pytest

from isospan.operators import dorling
from test_dorling import circles, overlaps, rows_of


def laid(spark, seed=7, n=150, wide=40):
    rng = random.Random(seed)
    return circles(spark, [(f"k{i}", rng.uniform(0, wide), rng.uniform(0, wide), 4.0 ** rng.uniform(-3, 0)) for i in range(n)] + [("same1", 5.0, 5.0, 1.0), ("same2", 5.0, 5.0, 1.0)])


@pytest.mark.parametrize("at_once, tile, step", [(8, 6, 0.5), (3, 0.5, 0.5), (4, 1, 0.001)])
def test_tiles_give_what_one_task_gives(spark, monkeypatch, at_once, tile, step):
    df = laid(spark)
    near = rows_of(dorling.dorling_layout(df, "w", k=1.6, together=500))
    monkeypatch.setattr(dorling, "AT_ONCE", at_once)
    monkeypatch.setattr(dorling, "TILE", tile)
    monkeypatch.setattr(dorling, "STEP", step)  # far less than circles move: made again with wider borders
    made = []
    in_tiles = dorling._in_tiles
    monkeypatch.setattr(dorling, "_in_tiles", lambda *a: made.append(a[2]) or in_tiles(*a))
    monkeypatch.setattr(dorling, "_round", lambda *a: pytest.fail("a round by joins"))
    far = rows_of(dorling.dorling_layout(df, "w", k=1.6, together=0))
    assert [r[0] for r in near] == [r[0] for r in far] and overlaps(far) == 0
    assert all(abs(p - q) < 1e-6 for a, b in zip(near, far) for p, q in zip(a[1:], b[1:]))
    assert max(made) <= 2 * at_once and len(made) > (1 if at_once < 8 else 0)


def test_full_tiles_go_by_joins(spark, monkeypatch):
    df = laid(spark, 9, 30, 12)
    near = rows_of(dorling.dorling_layout(df, "w", k=1.6, rounds=3, together=500))
    monkeypatch.setattr(dorling, "TILE_CIRCLES", 3)
    far = rows_of(dorling.dorling_layout(df, "w", k=1.6, rounds=3, together=0))
    assert all(abs(p - q) < 1e-6 for a, b in zip(near, far) for p, q in zip(a[1:], b[1:])) and len(near) == len(far) == 32


def test_near_pairs_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    x, y, r = rng.uniform(-8, 8, 400), rng.uniform(-8, 8, 400), 3.0 * 2.0 ** rng.uniform(-12, 0, 400)
    level = np.clip(np.floor(np.log2(3.0 / r)), 0, 16).astype(int)
    a, b = dorling._near_pairs(x, y, r, level, 3.0)
    want = {(i, j) for i in range(400) for j in range(i) if math.hypot(x[i] - x[j], y[i] - y[j]) < r[i] + r[j] - 3e-6}
    got = [(max(p), min(p)) for p in zip(a.tolist(), b.tolist())]
    assert set(got) == want and len(got) == len(want) > 300
