import math

import numpy as np
import pytest

from isospan.errors import SpineError
from isospan.operators import aggregate, diagnostics, joins, panel, resolve, spatial, stats, viz_prep
from isospan.sources.geometry import square_grid


def col(df, name, *order):
    return [r[name] for r in (df.orderBy(*order) if order else df).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def close(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b))


P = "iso3c string, year int, gdp double"


def test_aggregate(spark):
    df = frame(spark, [("USA", "NA", 21.0, 331.0), ("CAN", "NA", 1.7, 38.0), ("BRA", "LAC", 1.4, 213.0)], "iso3c string, region string, gdp double, pop double")
    assert close(col(aggregate.aggregate_regions(df, "gdp"), "gdp"), [1.4, 22.7])
    w = (21 * 331 + 1.7 * 38) / 369
    assert close(col(aggregate.aggregate_regions(df, "gdp", fun="weighted_mean", weight="pop"), "gdp"), [1.4, w])
    none = frame(spark, [("A", None, 1.0), ("A", 2.0, None)], "region string, gdp double, pop double")
    assert close(col(aggregate.aggregate_regions(none, "gdp", fun="weighted_mean", weight="pop"), "gdp"), [None])
    empty = none.where("gdp is null")
    assert [col(aggregate.aggregate_regions(empty, "gdp", fun=f), "gdp") for f in ("sum", "mean", "max")] == [[0.0], [None], [None]]
    for bad in (dict(by="nope"), dict(fun="weighted_mean"), dict(fun="mode")):
        with pytest.raises(SpineError):
            aggregate.aggregate_regions(df, "gdp", **bad)


def test_rank(spark):
    df = frame(spark, [("A", 3.0), ("B", 1.0), ("C", 2.0), ("D", None), ("E", 3.0)], "iso3c string, v double")
    out = panel.rank_countries(df, "v").orderBy("iso3c").collect()
    assert [r["rank"] for r in out] == [1, 4, 3, None, 1]
    assert close([r["percentile"] for r in out], [2 / 3, 0.0, 1 / 3, None, 2 / 3])
    within = panel.rank_countries(df.selectExpr("*", "'x' as g"), "v", within="g").orderBy("iso3c").collect()
    assert [tuple(r)[-3:-1] for r in within] == [(r["rank"], r["percentile"]) for r in out]
    assert close([r["z_score"] for r in within], [r["z_score"] for r in out])


def test_complete(spark):
    df = frame(spark, [("USA", 2000, 1.0), ("USA", 2002, 3.0)], P)
    assert col(panel.complete_years(df, method="linear"), "gdp", "year") == [1.0, 2.0, 3.0]
    df = frame(spark, [("USA", 2000, 1.0, "a", None), ("USA", 2002, None, None, "b"), ("X", 1990, 5.0, None, None)], P + ", s string, t string")
    got = panel.complete_years(df, [2000, 2001, 2002], method="locf").where("iso3c = 'USA'").orderBy("year").collect()
    assert [(r.gdp, r.s, r.t) for r in got] == [(1.0, "a", "b")] * 3
    assert sorted(col(panel.complete_years(df, [2000, 2001]).where("iso3c = 'X'"), "year")) == [1990, 2000, 2001]


def test_growth_index_lag(spark):
    df = frame(spark, [("USA", 2002, 121.0), ("USA", 2000, 100.0), ("USA", 2001, 110.0), ("B", 2000, 0.0), ("B", 2001, 5.0)], P)
    usa = lambda d, c: col(d.where("iso3c = 'USA'"), c, "year")
    assert close(usa(panel.growth_rate(df, "gdp"), "gdp_growth"), [None, 0.1, 0.1])
    assert close(usa(panel.growth_rate(df, "gdp", "cagr"), "gdp_growth"), [None, 0.1, 0.1])
    assert col(panel.growth_rate(df, "gdp").where("iso3c = 'B'"), "gdp_growth", "year") == [None, None]
    assert close(usa(panel.index_to(df, "gdp", 2000), "gdp_index"), [100.0, 110.0, 121.0])
    assert col(panel.index_to(df, "gdp", 2000).where("iso3c = 'B'"), "gdp_index") == [None, None]
    assert col(panel.index_to(df, "gdp", 1999), "gdp_index") == [None] * 5
    assert usa(panel.lag_by_country(df, "gdp"), "gdp_lag") == [None, 100.0, 110.0]
    assert usa(panel.lag_by_country(df, "gdp", 2), "gdp_lag2") == [None, None, 100.0]
    assert usa(panel.diff_by_country(df, "gdp"), "gdp_diff") == [None, 10.0, 11.0]
    with pytest.raises(SpineError):
        panel.lag_by_country(df, "gdp", 0)


def test_share_and_per_capita(spark):
    df = frame(spark, [("A", 5.0), ("B", 10.0), ("C", 5.0)], "iso3c string, co2 double")
    assert col(panel.share_of_world(df, "co2"), "co2_share", "iso3c") == [0.25, 0.5, 0.25]
    df = frame(spark, [("A", 1.0), ("B", None), ("C", 2.0)], "iso3c string, co2 double")
    assert close(col(panel.share_of_world(df, "co2"), "co2_share", "iso3c"), [1 / 3, None, 2 / 3])
    df = frame(spark, [("USA", 2020, 5e6, 331e6), ("CHN", 2020, 1e7, 0.0)], "iso3c string, year int, co2 double, pop double")
    assert close(col(panel.per_capita(df, "co2", "pop"), "co2_per_capita", "iso3c"), [None, 5 / 331])
    pop = frame(spark, [("USA", 2020, 10.0)], "iso3c string, year int, population double")
    assert close(col(panel.per_capita(df, "co2", population=pop), "co2_per_capita", "iso3c"), [None, 5e5])


def test_correlate(spark):
    df = frame(spark, [(1.0, 2.0, 4.0), (2.0, 4.0, 3.0), (3.0, 6.0, 2.0), (4.0, 8.0, 1.0)], "x double, y double, z double")
    for method in ("pearson", "spearman"):
        got = {(r.var_x, r.var_y): (round(r.r, 9), r.n) for r in stats.correlate_indicators(df, method=method).collect()}
        assert got == {("x", "y"): (1.0, 4), ("x", "z"): (-1.0, 4), ("y", "z"): (-1.0, 4)}
    few = frame(spark, [(1.0, 1.0), (2.0, None), (None, 3.0)], "x double, y double")
    assert tuple(stats.correlate_indicators(few).first()) == ("x", "y", None, 1)
    flat = frame(spark, [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert stats.correlate_indicators(flat).first().r is None
    with pytest.raises(SpineError):
        stats.correlate_indicators(flat, ["x"])


def test_convergence(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(30):
        v0 = math.exp(7 + i / 10)
        g = 0.05 - 0.004 * math.log(v0) + rng.normal(0, 0.001)
        rows += [(f"C{i}", 2000, v0), (f"C{i}", 2020, v0 * math.exp(20 * g))]
    fit = stats.fit_beta(frame(spark, rows, P), "gdp")
    x, g = np.array([math.log(r[2]) for r in rows[::2]]), np.array([math.log(b[2] / a[2]) / 20 for a, b in zip(rows[::2], rows[1::2])])
    beta = np.polyfit(x, g, 1)[0]
    assert abs(fit.beta - beta) < 1e-9 and fit.beta < 0 and fit.p_value < 0.01 and fit.n == 30 and fit.half_life > 0
    with pytest.raises(SpineError):
        stats.fit_beta(frame(spark, rows[:4], P), "gdp")
    df = frame(spark, [("A", 2000, 1.0), ("B", 2000, 10.0), ("C", 2000, 100.0), ("A", 2010, 2.0), ("B", 2010, 11.0), ("C", 2010, 60.0)], P)
    for m in ("sd_log", "cv"):
        s = col(stats.sigma_convergence(df, "gdp", m), "sigma")
        assert s[1] < s[0]


def test_student_t():
    from isospan.functions.stats import natural_breaks, t_two_sided

    assert abs(t_two_sided(2.0, 10) - 0.07338803477074037) < 1e-10 and abs(t_two_sided(0.0, 5) - 1) < 1e-12
    assert natural_breaks([1, 2, 3, 50, 51, 52, 100], 3) == [1, 3, 52, 100] and natural_breaks([], 3) == [] and natural_breaks([4], 3) == [4]


def test_gini(spark):
    g = lambda rows: aggregate.gini(frame(spark, rows, "x double, w double"), "x", "w").first()[0]
    assert abs(g([(5.0, 1.0)] * 3)) < 1e-12 and abs(g([(0.0, 1.0), (0.0, 1.0), (1.0, 1.0)]) - 2 / 3) < 1e-12
    assert abs(g([(1.0, 3.0), (5.0, 1.0)]) - g([(1.0, 1.0)] * 3 + [(5.0, 1.0)])) < 1e-12
    assert g([]) is None and abs(g([(1.0, 1.0), (None, 1.0), (1.0, 1.0)])) < 1e-12
    with pytest.raises(Exception, match="negative"):
        g([(1.0, -1.0)])
    rng = np.random.default_rng(2)
    x = np.round(rng.exponential(size=3000), 2)
    want = np.abs(x[:, None] - x[None]).sum() / (2 * len(x) ** 2 * x.mean())
    assert abs(g([(float(v), 1.0) for v in x]) - want) < 1e-9


def test_theil(spark):
    rows = list(zip([1.0, 2.0, 8.0, 9.0, 30.0, 40.0], [1.0, 2.0] * 3, "aabbcc"))
    df = frame(spark, rows, "x double, w double, g string")
    x, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    m = (x * w).sum() / w.sum()
    want = ((w / w.sum()) * (x / m) * np.log(x / m)).sum()
    assert abs(aggregate.theil(df, "x", "w").first()[0] - want) < 1e-12
    parts = {r.component: r.value for r in aggregate.theil(df, "x", "w", "g").collect()}
    assert abs(parts["between"] + parts["within"] - want) < 1e-12
    assert aggregate.theil(df.where("x < 0"), "x", groups="g").count() == 3 and aggregate.theil(df.where("x < 0"), "x").first()[0] is None


def test_joins(spark):
    x = frame(spark, [("France", 1), ("Germany", 2)], "c string, x int")
    y = frame(spark, [("Germany", 3), ("Japan", 4)], "c string, y int")
    assert [joins.country_join(x, y, "c", how=h).count() for h in ("inner", "left", "full")] == [1, 2, 3]
    assert joins.country_join(x, y, "c").columns == ["c.x", "x", "iso3c", "c.y", "y"]
    a = frame(spark, [("Czechia", 1.0), ("South Korea", 2.0)], "country string, gdp double")
    b = frame(spark, [("Czech Republic", 3.0), ("Korea, Rep.", 4.0)], "nation string, pop double")
    c = frame(spark, [("Czechia", 5.0), ("Korea", 6.0)], "country string, area double")
    out = joins.country_join_all([a, b, c], ["country", "nation", "country"])
    assert sorted((r.iso3c, r.gdp, r.pop, r.area) for r in out.collect()) == [("CZE", 1.0, 3.0, 5.0), ("KOR", 2.0, 4.0, 6.0)]
    with pytest.raises(SpineError):
        joins.country_join_all([a, b], ["country"])
    nulls = frame(spark, [(None, 1)], "iso3c string, v int")
    assert joins.spine_join(nulls, nulls, "inner").count() == 1 and joins.spine_join(nulls, nulls, "inner", na_matches="never").count() == 0


def test_standardize_replaces_columns(spark):
    df = frame(spark, [("Kosovo", 1), ("Canary Islands", 2)], "region string, v int")
    out = resolve.standardize_country(df, "region", add=("continent", "region"))
    assert out.columns == ["v", "iso3c", "continent", "region"] and col(out, "region", "v") == ["Europe & Central Asia"] * 2
    assert resolve.detect_country_col(frame(spark, [("x", "France"), ("y", "Peru")], "a string, b string")) == "b"
    assert resolve.detect_country_col(df.withColumnRenamed("region", "Nation")) == "Nation"
    with pytest.raises(SpineError):
        resolve.detect_country_col(frame(spark, [("x",)], "a string"))


def test_geometry_join(spark):
    ring = square_grid(spark, ["USA", "CAN", "MEX"])
    out = joins.attach_geometry(frame(spark, [("USA", 1.0), ("FRA", 2.0)], "iso3c string, value double"), ring)
    assert out.count() == 12 and out.where("value is not null").count() == 4 and out.where("iso3c = 'FRA'").count() == 0


def test_diagnostics(spark):
    df = frame(spark, [(n,) for n in ("USA", "Cote d'Ivoire", "Yugoslavia", "Wakanda", "USSR", "France", "Germny", None)], "n string")
    got = {r.input: r for r in diagnostics.check_country_match(df, "n").collect()}
    assert len(got) == 8 and [got[k].matched for k in ("USA", "Cote d'Ivoire", "Yugoslavia", "Wakanda")] == [True, True, False, False]
    assert got["USSR"].iso3c == "RUS" and got["USSR"].historical == "Soviet Union"
    assert got["Germny"].suggestion == "Germany" and got["Wakanda"].suggestion == "Canada" and got["Yugoslavia"].suggestion == "Yugoslavia"
    bad = frame(spark, [("United States",), ("Brzil",), ("Germny",), ("Yugoslavia",), ("Wakanda",)], "n string")
    fixed, repairs = diagnostics.repair_country_names(bad, "n")
    assert sorted(col(fixed, "n")) == ["Brazil", "Germany", "United States", "Wakanda", "Yugoslavia"] and repairs.count() == 2
    assert diagnostics.repair_country_names(bad, "n", threshold=0)[1].count() == 0


def test_dissolve(spark):
    names = ["USSR", "Yugoslavia", "France", "czechoslovakia", "German Democratic Republic", "Wakanda", "Sudan", "Sudan (former)", "USSR"]
    out = diagnostics.dissolve_country(frame(spark, [(n,) for n in names], "n string"), "n")
    n = {r.input: r["count"] for r in out.groupBy("input").count().collect()}
    assert n == {"USSR": 30, "Yugoslavia": 7, "France": 1, "czechoslovakia": 2, "German Democratic Republic": 1, "Wakanda": 1, "Sudan": 1, "Sudan (former)": 2}
    assert out.where("input = 'France'").first().country == "France" and out.where("input = 'Wakanda'").first().iso3c is None


def test_audit(spark):
    df = frame(spark, [("A", "R", 1.0, None), ("B", "R", None, 2.0), (None, "S", float("nan"), 1.0)], "iso3c string, region string, x double, y double").selectExpr("*", "coalesce(iso3c, 'Nowhere') as country")
    got = aggregate.audit_coverage(df)
    assert {r.indicator: (r.n, r.n_missing) for r in got.na_rates.collect()} == {"x": (3, 2), "y": (3, 1)}
    assert [(r.region, r.n_countries, r.na_rate) for r in got.by_group.collect()] == [("S", 1, 1.0), ("R", 2, 0.5)]
    assert col(got.unmatched, "country") == ["Nowhere"] and aggregate.audit_coverage(df, by="nope").by_group.count() == 0


def test_spatial(spark):
    ring = square_grid(spark, ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF"])
    edges = {tuple(r) for r in spatial.country_borders(ring).collect()}
    assert ("AAA", "BBB") in edges and ("AAA", "FFF") in edges and ("AAA", "CCC") not in edges
    assert spatial.neighbors(spatial.country_borders(ring), ["AAA"], "iso3c").count() == 2
    assert {tuple(r) for r in spatial.polygon_centroids(ring).where("iso3c = 'AAA'").collect()} == {("AAA", -15.0, -15.0)}
    area = spatial.ring_areas(ring).where("iso3c = 'AAA'").first().area_km2
    R = 6371.0088
    assert abs(area - R * R * math.radians(10) * (math.sin(math.radians(20)) - math.sin(math.radians(10)))) / area < 0.01
    pts = frame(spark, [(1, -15.0, -15.0), (2, -5.0, -15.0), (3, 60.0, 60.0), (4, -20.1, -15.0), (5, None, 1.0)], "i int, lon double, lat double")
    assert col(spatial.locate_country(pts, ring), "iso3c", "i") == ["AAA", "BBB", None, "AAA", None]
    assert col(spatial.locate_country(pts, ring, tolerance_km=0), "iso3c", "i") == ["AAA", "BBB", None, None, None]
    cut = spatial.clip_box(ring, -18.0, -18.0, -12.0, -12.0).where("iso3c = 'AAA'").agg({"long": "min", "lat": "max"}).first()
    assert tuple(sorted(cut)) == (-18.0, -12.0)
    assert spatial.simplify_geometry(ring, 0.5).count() == ring.count()  # four vertices are the least
    east = frame(spark, [("FJI", 1, i + 1, x, y) for i, (x, y) in enumerate([(178.0, -18.0), (-178.0, -18.0), (-178.0, -16.0), (178.0, -16.0)])], "iso3c string, `group` int, `order` int, long double, lat double")
    split = spatial.split_antimeridian(east)
    assert split.select("group").distinct().count() == 2 and split.where("abs(long) = 180").count() >= 4


def test_moran(spark):
    ring = square_grid(spark, [f"C{i:02d}" for i in range(25)])
    df = frame(spark, [(f"C{i:02d}", float(i // 5)) for i in range(25)], "iso3c string, v double")
    got = stats.morans_i(df, "v", spatial.country_borders(ring), n_perm=99).first()
    assert got.morans_i > 0.4 and abs(got.expected + 1 / 24) < 1e-12 and got.p_value <= 0.05 and got.n == 25
    edges = {tuple(r) for r in spatial.country_borders(ring).collect()}
    W = np.zeros((25, 25))
    for a, b in edges:
        W[int(a[1:]), int(b[1:])] = W[int(b[1:]), int(a[1:])] = 1
    W /= W.sum(1, keepdims=True)
    z = np.array([i // 5 for i in range(25)], float)
    z -= z.mean()
    assert abs(got.morans_i - z @ W @ z / (z @ z)) < 1e-9
    assert stats.morans_i(df, "v", spatial.country_borders(ring), n_perm=0).first().p_value is None


def test_viz(spark):
    rows = [("A", 1, 0.0, 0.0, 1.0)] * 100 + [("B", 2, 0.0, 0.0, 2.0), ("C", 3, 0.0, 0.0, 3.0), ("D", 4, 0.0, 0.0, 4.0)]
    df = frame(spark, rows, "iso3c string, `group` int, long double, lat double, val double")
    out = viz_prep.world_map(df, "val", "quantile", 4)
    assert sorted({(r.iso3c, r.bin) for r in out.collect()}) == [("A", 1), ("B", 2), ("C", 3), ("D", 4)]
    one = frame(spark, [("A", 5.0), ("B", 5.0), ("C", None)], "iso3c string, v double")
    assert col(viz_prep.world_map(one, "v", "quantile"), "bin", "iso3c") == [1, 1, None]
    assert viz_prep.compute_breaks(one, "v", "jenks") == [5.0] and viz_prep.compute_breaks(one.limit(0), "v") == []
    geo = frame(spark, [("CHN", 100.0, 30.0), ("USA", -100.0, 40.0), ("DEU", 10.0, 50.0), ("FRA", 2.0, 47.0)], "iso3c string, lon double, lat double")
    flows = frame(spark, [("China", "United States", 5.0), ("Germany", "France", 2.0), ("Wakanda", "France", 1.0)], "from string, to string, value double")
    arcs = viz_prep.flow_arcs(flows, "from", "to", geo, "value", n=25)
    assert arcs.count() == 50 and arcs.select("flow_id").distinct().count() == 2
    assert viz_prep.flow_arcs(flows.where("value = 1"), "from", "to", geo, "value").count() == 0
    spikes = viz_prep.spike_triangles(frame(spark, [("USA", 4.0), ("FRA", 1.0), ("DEU", -1.0)], "iso3c string, v double"), "v", geo)
    assert spikes.count() == 6 and abs(spikes.agg({"y": "max"}).first()[0] - 60) < 1e-9
    tiles = viz_prep.world_tiles([("A", 0.0, 50.0), ("B", 0.0, 50.0), ("C", 90.0, -10.0), ("D", None, 1.0)])
    assert len(tiles) == 3 and len({t[1:] for t in tiles}) == 3
    assert viz_prep.globe_frames(4) == [0.0, 90.0, 180.0, 270.0] and len(viz_prep.globe_frames(1)) == 2
    circles = viz_prep.dorling([("A", 0.0, 0.0, 4.0), ("B", 0.1, 0.0, 4.0), ("C", 50.0, 0.0, 1.0), ("D", 0, 0, None)])
    (_, x0, y0, r0), (_, x1, y1, r1), _ = circles
    assert len(circles) == 3 and math.hypot(x0 - x1, y0 - y1) >= r0 + r1 - 1e-3


def test_great_circle_and_projections(spark):
    from pyspark.sql import functions as F

    from isospan.functions.geo import PROJECTIONS, great_circle, project, projection_string

    df = frame(spark, [(0.0, 0.0, 90.0, 0.0), (5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 180.0, 0.0)], "a double, b double, c double, d double")
    arcs = [r[0] for r in df.select(great_circle(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 25)).collect()]
    assert len(arcs[0]) == 25 and abs(arcs[0][12].lon - 45) < 1e-9 and all(abs(p.lon - 5) < 1e-9 for p in arcs[1]) and all(math.isfinite(p.lon) for p in arcs[2])
    for p in PROJECTIONS:
        r = df.limit(1).select(project(F.lit(30.0), F.lit(40.0), p).alias("p")).first().p
        o = df.limit(1).select(project(F.lit(0.0), F.lit(0.0), p).alias("p")).first().p
        assert math.isfinite(r.x) and math.isfinite(r.y) and r.y > o.y and r.x > o.x, p
    assert "proj=eqc" in projection_string("equirectangular") and "proj=wintri" in projection_string("winkel_tripel") and "lat_0=30" in projection_string("orthographic", lat0=30)
    with pytest.raises(SpineError):
        projection_string("flat")
