import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from isospan.functions.text import jaro, jaro_similarity
from isospan.operators import viz_prep
from isospan.operators.globe import clip_globe, visible_parts
from test_overlay import box, frame_of, inside


def flat(parts, lon0, lat0):
    """Orthographic rings and the least height of their points above the limb."""
    rings, low = [], 1.0
    p0 = math.radians(lat0)
    for part in parts:
        ring = []
        for x, y, _ in part:
            p, d = math.radians(y), math.radians(x - lon0)
            low = min(low, math.sin(p0) * math.sin(p) + math.cos(p0) * math.cos(p) * math.cos(d))
            ring.append((math.cos(p) * math.sin(d), math.cos(p0) * math.sin(p) - math.sin(p0) * math.cos(p) * math.cos(d)))
        rings.append(ring)
    return rings, low


def dense(ring, n=60):
    """Edges followed in small steps, so that straight lines on both maps agree."""
    return [(x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * i / n) for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]) for i in range(n)]


CASES = [box(60, -40, 120, 40), box(-20, -10, 20, 10), box(100, -80, 170, 80), [(60, -30), (150, -30), (150, 30), (60, 30), (60, 20), (130, 20), (130, -20), (60, -20)], box(-89, -30, 89, 30), [(85, -50), (100, -40), (85, -30), (100, -20), (85, -10), (130, -10), (130, -55)]]


@pytest.mark.parametrize("lon0, lat0", [(0.0, 0.0), (15.0, 35.0), (40.0, -60.0)])
@pytest.mark.parametrize("turn", [1, -1])
def test_what_is_drawn_is_what_is_seen(lon0, lat0, turn):
    rng = random.Random(1)
    for ring in CASES:
        ring = dense(ring)[::turn]
        parts = visible_parts(ring, lon0, lat0, 1.0)
        rings, low = flat(parts, lon0, lat0)
        assert low >= 0
        wrong = 0
        for _ in range(1500):
            r, a = math.sqrt(rng.random()) * 0.99, rng.uniform(0, math.tau)
            x, y = r * math.cos(a), r * math.sin(a)
            z, p0 = math.sqrt(1 - r * r), math.radians(lat0)
            lat = math.degrees(math.asin(z * math.sin(p0) + y * math.cos(p0)))
            lon = lon0 + math.degrees(math.atan2(x, z * math.cos(p0) - y * math.sin(p0)))
            lon = (lon + 180) % 360 - 180
            wrong += inside(rings, x, y) != inside([ring], lon, lat)
        assert wrong <= 6  # points within a step of an edge


def test_rings_out_of_sight_and_around_everything():
    assert visible_parts(box(170, -10, 179, 10), 0.0, 0.0) == [] and visible_parts([(0, 0), (1, 1)], 0.0, 0.0) == []
    disc, low = flat(visible_parts(box(-179, -89, 179, 89), 0.0, 0.0), 0.0, 0.0)
    area = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(disc[0], disc[0][1:] + disc[0][:1])) / 2
    assert low >= 0 and area == pytest.approx(math.pi, rel=1e-3)


def test_clipped_frames(spark):
    frame = frame_of(spark, [("A", "x", [box(80, -5, 100, 5)]), ("B", "x", [box(0, 0, 5, 5)]), ("C", "x", [box(150, 0, 160, 5)])]).withColumn("part", F.lit("clash"))
    out = clip_globe(frame)
    assert out.columns == [*frame.columns, "part_", "limb"]
    rows = out.collect()
    assert {r["iso3c"] for r in rows} == {"A", "B"} and all(r["part"] == "clash" for r in rows)
    assert sum(not r["limb"] for r in rows if r["iso3c"] == "A") == 2 and not any(r["limb"] for r in rows if r["iso3c"] == "B")
    data = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "iso3c string, v double")
    assert all(r["visible"] for r in viz_prep.globe_map(data, frame.drop("part"), "v", clip=True).collect())


def test_jaro_as_an_expression(spark):
    rng = random.Random(3)
    words = ["", "a", "b", "ab", "ba", "Wakanda", "Canada", "Germny", "Germany", "éèê", "dwayne", "duane", "aaaa", "𝄞x"] + ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", jaro_similarity(F.col("a"), F.col("b")).alias("s"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for r in got.collect():
        if r["a"] is None or r["b"] is None:
            assert r["s"] is None
            continue
        assert r["s"] == pytest.approx(jaro(r["a"], r["b"]), abs=1e-12)
    some = [(r["a"], r["b"], r["s"]) for r in got.where("a <> '' and b <> ''").collect()]
    con.execute("CREATE TABLE t (a VARCHAR, b VARCHAR, s DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", some[:3000])
    assert con.execute("SELECT count(*) FROM t WHERE abs(jaro_similarity(a, b) - s) > 1e-9").fetchone()[0] == 0
