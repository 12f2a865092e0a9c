import random
import warnings

import pytest
from pyspark.sql import functions as F

from isospan.operators import aggregate, panel, prefix, resolve, stats, viz_prep
from isospan.operators.spatial import locate_country


def skewed(n=4000, seed=3):
    """(k, g, v): half of v is 0, a tenth null, one group holds most rows."""
    rng = random.Random(seed)
    return [(i, None if i % 50 == 0 else "big" if rng.random() < 0.7 else f"g{i % 7}", None if i % 10 == 9 else 0.0 if i % 2 else float(rng.randrange(60))) for i in range(n)]


def plain_rank(rows, desc):
    known = sorted(v for v in rows if v is not None)
    below = {v: sum(x < v for x in known) for v in set(known)}
    ties = {v: known.count(v) for v in set(known)}
    return {v: (len(known) - below[v] - ties[v] + 1 if desc else below[v] + 1) for v in below}


@pytest.mark.parametrize("most", [100, 1_000_000])
@pytest.mark.parametrize("within, desc", [(None, True), (None, False), ("g", True), ("g", False)])
def test_ranks_with_frequent_values(spark, monkeypatch, within, desc, most):
    monkeypatch.setattr(prefix, "WINDOW_ROWS", most)
    rows = skewed()
    df = spark.createDataFrame(rows, "k long, g string, v double").withColumns({"x": F.lit("clash"), "n": F.lit("clash"), "_range": F.lit(1)})
    got = panel.rank_countries(df, "v", within=within, desc=desc)
    assert got.columns == [*df.columns, "rank", "percentile", "z_score"]
    groups = {}
    for _, g, v in rows:
        groups.setdefault(g if within else "", []).append(v)
    want = {g: plain_rank(v, desc) for g, v in groups.items()}
    for r in got.collect():
        assert r["rank"] == (None if r["v"] is None else want[r["g"] if within else ""][r["v"]]) and r["x"] == "clash"


def test_join_values_reaches_every_row_once(spark):
    rows = spark.createDataFrame(skewed(), "k long, g string, v double")
    per = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
    got = prefix.join_values(rows, per, ["v"], "n", ["total"])
    want = {r["v"]: r["total"] for r in per.collect()}
    found = got.collect()
    assert len(found) == 4000 and all(r["total"] == want[r["v"]] for r in found)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_share_by_year_with_null_years(spark, monkeypatch, most):
    monkeypatch.setattr(prefix, "WINDOW_ROWS", most)
    df = spark.createDataFrame([(1, 2.0), (1, 6.0), (None, 5.0), (2, None)], "year int, v double").withColumn("total", F.lit("clash"))
    got = sorted((tuple(r) for r in panel.share_of_world(df, "v").collect()), key=str)
    assert got == sorted([(1, 2.0, "clash", 0.25), (1, 6.0, "clash", 0.75), (None, 5.0, "clash", 1.0), (2, None, "clash", None)], key=str)


def test_spearman_with_ties(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(5)), float(rng.randrange(3))) for _ in range(300)]
    r = stats.correlate_indicators(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], "spearman").first()["r"]

    def ranks(x):
        return [sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x]

    a, b = (ranks([row[i] for row in rows]) for i in (0, 1))
    ma, mb = sum(a) / 300, sum(b) / 300
    want = sum((p - ma) * (q - mb) for p, q in zip(a, b)) / (sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b)) ** 0.5
    assert abs(r - want) < 1e-9


def test_negative_weights_stop(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, -1.0)], "v double, w double")
    for f in (aggregate.gini, aggregate.theil):
        with pytest.raises(Exception, match="negative"):
            f(df, "v", "w").collect()


def test_theil_says_what_it_leaves_out(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-2.0,), (None,)], "v double")
    with pytest.warns(UserWarning, match="2 values"):
        aggregate.theil(df, "v", warn=True)


def test_natural_breaks_never_change_with_size(spark):
    few = spark.createDataFrame([(f"c{i}", float(i * i)) for i in range(50)], "iso3c string, v double")
    assert len(viz_prep.compute_breaks(few, "v", "jenks", 4)) == 5
    many = spark.range(5000).select(F.col("id").cast("string").alias("iso3c"), F.col("id").alias("v"))
    assert viz_prep.compute_breaks(many, "v", "jenks", 4) == [0.0, 1249.0, 2499.0, 3749.0, 4999.0]


def test_warning_counts_what_it_does_not_name(spark):
    df = spark.createDataFrame([(f"nowhere {i}",) for i in range(25)], "country string")
    with pytest.warns(UserWarning, match="and 5 more"):
        resolve.standardize_country(df, "country", warn=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        resolve.standardize_country(spark.createDataFrame([("France",)], "country string"), "country", warn=True)


def test_points_across_the_antimeridian(spark, monkeypatch):
    from isospan.operators import spatial

    corners = [(176.0, -20.0), (180.0, -20.0), (180.0, -10.0), (176.0, -10.0)]
    frame = spark.createDataFrame([("FJI", 1, i, x, y) for i, (x, y) in enumerate(corners)], "iso3c string, `group` int, `order` int, long double, lat double")
    points = spark.createDataFrame([(1, -179.9, -15.0, "a"), (2, 178.0, -15.0, "b"), (3, -170.0, -15.0, "c"), (4, None, 1.0, "d")], "k int, lon double, lat double, spot string")
    for most in (500_000, 1):
        monkeypatch.setattr(spatial, "BROADCAST_VERTICES", most)
        got = {r["k"]: r["iso3c"] for r in locate_country(points, frame, tolerance_km=25).collect()}
        assert got == {1: "FJI", 2: "FJI", 3: None, 4: None}


def test_simplified_neighbours_still_share_their_border(spark):
    from isospan.operators.spatial import simplify_geometry

    rng = random.Random(2)
    border = [(10 + rng.uniform(-0.2, 0.2), y / 4) for y in range(1, 40)]
    left = [(0.0, 0.0), (10.0, 0.0), *border, (10.0, 10.0), (0.0, 10.0)]
    right = [(20.0, 0.0), (20.0, 10.0), (10.0, 10.0), *border[::-1], (10.0, 0.0)]
    island = [(30 + (5 if k % 2 else 4.9) * x, 5 + (5 if k % 2 else 4.9) * y) for k, (x, y) in enumerate([(1, 0), (0.7, 0.7), (0, 1), (-0.7, 0.7), (-1, 0), (-0.7, -0.7), (0, -1), (0.7, -0.7)])]
    rows = [(c, g, i, x, y) for c, g, ring in (("AAA", 1, left), ("BBB", 2, right), ("CCC", 3, island)) for i, (x, y) in enumerate(ring)]
    frame = spark.createDataFrame(rows, "iso3c string, `group` int, `order` int, long double, lat double")
    kept = simplify_geometry(frame, 0.3).collect()
    on = lambda g: {(r["long"], r["lat"]) for r in kept if r["group"] == g and 9 < r["long"] < 11}
    assert on(1) == on(2) and {(10.0, 0.0), (10.0, 10.0)} <= on(1) and 2 < len(on(1)) < 30
    assert len([r for r in kept if r["group"] == 3]) >= 4 and len(kept) < 0.5 * len(rows)
    assert simplify_geometry(frame, 1.0).count() == len(rows)


def test_flagship_plan_stays_small(spark, sf):
    from isospan import catalog

    plan = catalog.queries()["flagship_panel"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 6 and plan.count("Exchange hashpartitioning") <= 4
