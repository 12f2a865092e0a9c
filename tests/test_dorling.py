"""Circles pushed apart: joins by cell against one task, and no overlap by brute force."""

import math
import random

import pytest

from isospan.errors import SpineError
from isospan.operators import dorling, viz_prep


def overlaps(rows):
    return sum(math.hypot(a[1] - b[1], a[2] - b[2]) < a[3] + b[3] - 1e-5 for i, a in enumerate(rows) for b in rows[:i])


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def circles(spark, rows):
    return spark.createDataFrame(rows, "iso3c string, lon double, lat double, w double")


def test_joins_give_what_one_task_gives(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", rng.uniform(0, 30), rng.uniform(0, 20), 4.0 ** rng.randint(-4, 3)) for i in range(60)] + [("same1", 5.0, 5.0, 9.0), ("same2", 5.0, 5.0, 9.0)]
    df = circles(spark, rows)
    near, far = (rows_of(dorling.dorling_layout(df, "w", k=2.0, together=n)) for n in (500, 0))
    assert [r[0] for r in near] == [r[0] for r in far] == sorted(r[0] for r in rows)
    assert all(abs(p - q) < 1e-6 for a, b in zip(near, far) for p, q in zip(a[1:], b[1:]))
    assert overlaps(near) == 0 and overlaps([(*r[:3], 2.0 * math.sqrt(r[3] / 64)) for r in rows]) > 10
    for c in (1, 2):  # halves on both sides: the mean stays
        assert abs(sum(r[c] for r in near) - sum(r[c] for r in rows)) < 1e-6


def test_every_overlapping_pair_meets_across_levels(spark):
    rng = random.Random(5)
    rows = [(f"k{i}", rng.uniform(-8, 8), rng.uniform(-8, 8), 4.0 ** rng.uniform(-12, 0)) for i in range(300)]
    made = dorling._circles(circles(spark, rows), "iso3c", "lon", "lat", "w", 3.0).selectExpr("*", "0.01D AS m")
    levels = sorted(r[0] for r in made.select("level").distinct().collect())
    got = sorted(tuple(sorted((r["key_a"], r["key_b"]))) for r in dorling.touching_circles(made, 3.0, levels).collect())
    c = [(r["key"], r["x"], r["y"], r["r"]) for r in made.collect()]
    want = sorted(tuple(sorted((a[0], b[0]))) for i, a in enumerate(c) for b in c[:i] if math.hypot(a[1] - b[1], a[2] - b[2]) < a[3] + b[3] - 3e-6)
    assert got == want and len(got) > 300 and len(levels) > 8


def test_circles_in_one_place_are_spread_before_they_meet(spark):
    df = circles(spark, [(f"k{i}", 1.0, 2.0, 1.0) for i in range(3000)] + [("far", 500.0, 0.0, 1.0)])
    made = dorling._circles(df, "iso3c", "lon", "lat", "w", 1.0)
    out = dorling._spread(made, 1.0)
    assert out.count() == 3001 and rows_of(out.where("key = 'far'").select("x", "y")) == [(500.0, 0.0)]
    assert dorling.touching_circles(out.selectExpr('*', '0.01D AS m'), 1.0, [0]).count() < 3001 * 20  # 4.5 million pairs before
    again = dorling._spread(made, 1.0)
    assert rows_of(out) == rows_of(again)


def test_missing_values_repeats_and_nothing(spark):
    nan, inf = float("nan"), math.inf
    df = circles(spark, [("A", 0.0, 0.0, 1.0), ("A", 9.0, 9.0, 4.0), ("A", 8.0, 9.0, 4.0), (None, 0.0, 0.0, 1.0), ("B", nan, 0.0, 1.0), ("C", 0.0, None, 1.0), ("D", 1.0, 1.0, nan), ("E", 1.0, 1.0, -1.0), ("F", 1.0, inf, 1.0), ("G", 1.0, 1.0, inf)])
    assert rows_of(dorling.dorling_layout(df, "w", k=3.0)) == [("A", 8.0, 9.0, 3.0)]
    for empty in (df.where("w < 0"), df.limit(0)):
        with pytest.raises(SpineError):
            dorling.dorling_layout(empty, "w")


def test_map_kinds(spark):
    df = circles(spark, [("A", 0.0, 0.0, 4.0), ("B", 0.1, 0.0, 4.0), ("C", 50.0, 0.0, 1.0)])
    got = rows_of(viz_prep.dorling_map(df.select("iso3c", "w"), "w", df.select("iso3c", "lon", "lat")))
    assert [g[0] for g in got] == ["A", "B", "C"] and overlaps(got) == 0 and got[2][1:] == (50.0, 0.0, 2.5)
    with pytest.raises(SpineError):
        viz_prep.cartogram_map(df, "w", df, kind="round")
