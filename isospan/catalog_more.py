"""Registered queries of operators whose expected rows are literals or closed formulas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import _LATEST, query, r6
from .operators import aggregate, joins, spatial, stats, viz_prep
from .plans import fixtures as fx
from .shared import cut, new_folder
from .sources import indicators, world
from .streaming import standardize_stream


def _literal(sql_rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {fx.values(sql_rows)}) t({names})"


# -- resolution: spellings and schemes, expected codes written out ------------------

# Spellings and the codes they stand for.
SPELLINGS = [
    ("Kingdom of Spain", "ESP"), ("French Republic", "FRA"), ("Republic of India", "IND"), ("Dominican Rep.", "DOM"), ("Central African Rep.", "CAF"),
    ("Eq. Guinea", "GNQ"), ("United Arab Em.", "ARE"), ("United States of America (the)", "USA"), ("Republic of Korea", "KOR"), ("Korea, Rep. of", "KOR"),
    ("Dem. Rep. Congo", "COD"), ("Congo, Dem. Rep. of the", "COD"), ("Bosnia and Herz.", "BIH"), ("Solomon Is.", "SLB"), ("Marshall Is.", "MHL"),
    ("N. Korea", "PRK"), ("S. Sudan", "SSD"), ("W. Sahara", "ESH"), ("Republic of the Union of Myanmar", "MMR"), ("People's Democratic Republic of Algeria", "DZA"),
    ("Venezuela, Bolivarian Republic of", "VEN"), ("Federal Democratic Republic of Ethiopia", "ETH"), ("Republic of China", "TWN"), ("Republic of Ireland", "IRL"),
    ("Grand Duchy of Luxembourg", "LUX"), ("St. Lucia", "LCA"), ("Czech Rep.", "CZE"), ("Lao People's Dem. Rep.", "LAO"), ("The Republic of the Philippines", "PHL"),
    ("Hashemite Kingdom of Jordan", "JOR"), ("Swiss Confederation", "CHE"), ("Korea (Republic of)", "KOR"), ("U.S.", "USA"), ("U.K.", "GBR"), ("Viet Nam", "VNM"),
    ("Guinea-Bissau", "GNB"), ("Guinea", "GIN"), ("Micronesia (Federated States of)", "FSM"), ("People's Republic of China", "CHN"), ("Cote d'Ivoire", "CIV"), ("Gambia, The", "GMB"),
    ("Niger", "NER"), ("Nigeria", "NGA"), ("Timor-Leste", "TLS"), ("Republic of the Congo", "COG"), ("Kosovo", "XKX"), ("Virgin Islands", "VIR"), ("Wakanda", None), ("Yugoslavia", None), ("", None),
]


# -- projections ------------------------------------------------------------------------

_PLANE = {
    "equirectangular": ("l", "p"),
    "gall_peters": ("l * cos(pi() / 4)", "sin(p) / cos(pi() / 4)"),
    "natural_earth": ("l * (0.8707 - 0.131979 * p * p - 0.013791 * pow(p, 4) + 0.003971 * pow(p, 10) - 0.001529 * pow(p, 12))", "p * (1.007226 + 0.015085 * p * p - 0.044475 * pow(p, 6) + 0.028874 * pow(p, 8) - 0.005916 * pow(p, 10))"),
    "equal_earth": ("2 * sqrt(3) * l * cos(t) / (3 * (9 * 0.003796 * pow(t, 8) + 7 * 0.000893 * pow(t, 6) - 3 * 0.081106 * t * t + 1.340264))", "0.003796 * pow(t, 9) + 0.000893 * pow(t, 7) - 0.081106 * pow(t, 3) + 1.340264 * t"),
    "winkel_tripel": ("(l * 2 / pi() + 2 * cos(p) * sin(l / 2) / s) / 2", "(p + sin(p) / s) / 2"),
    "albers": ("r * sin(n * l)", "sqrt(c) / n - r * cos(n * l)"),
}
_ANGLES = """SELECT iso3c, l, p, asin(sqrt(3) / 2 * sin(p)) AS t, CASE WHEN a = 0 THEN 1 ELSE sin(a) / a END AS s, n, c, sqrt(c - 2 * n * sin(p)) / n AS r FROM (
  SELECT iso3c, radians(lon) AS l, radians(lat) AS p, acos(cos(radians(lat)) * cos(radians(lon) / 2)) AS a, (sin(radians(29.5)) + sin(radians(45.5))) / 2 AS n,
  pow(cos(radians(29.5)), 2) + (sin(radians(29.5)) + sin(radians(45.5))) * sin(radians(29.5)) AS c FROM geo)"""


def _bisected(f: str, aim: str) -> str:
    """The angle in [-pi/2, pi/2] at which the rising function f is aim: 60 halvings."""
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 61), lambda i: pi() / pow(2, i + 1))), lambda a, h: a + h * sign({aim} - ({f})))"


_SOLVED = f", solved AS (SELECT c_custkey, radians(lon) AS l, {_bisected('2 * a + sin(2 * a)', 'pi() * sin(radians(lat))')} AS m, {_bisected('a + sin(a) * cos(a) + 2 * sin(a)', '(2 + pi() / 2) * sin(radians(lat))')} AS e FROM spots) "

_ROBINSON = [(0, 1.0, 0.0), (15, 0.99, 0.186), (30, 0.96, 0.372), (45, 0.8962, 0.5571), (60, 0.7986, 0.7346), (75, 0.6732, 0.8936), (90, 0.5322, 1.0)]


# -- space ----------------------------------------------------------------------------


@query(_literal([(25, 0, True)], "circles, overlapping, largest_first"))
def dorling_circles(spark, sf):
    c = fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp")
    out = cut(viz_prep.dorling_map(c, "gdp", fx.geo(spark)))
    near = lambda p, q: F.sqrt(F.pow(F.col(f"{p}.lon") - F.col(f"{q}.lon"), 2) + F.pow(F.col(f"{p}.lat") - F.col(f"{q}.lat"), 2)) < F.col(f"{p}.r") + F.col(f"{q}.r") - 1e-3
    over = out.alias("a").join(out.alias("b"), F.expr("a.iso3c < b.iso3c") & near("a", "b")).agg(F.count(F.lit(1)).cast("int").alias("overlapping"))
    top, first = (d.agg(F.max_by("iso3c", w).alias(n)) for d, w, n in ((out, "r", "largest"), (c, "gdp", "richest")))
    n = out.agg(F.count(F.lit(1)).cast("int").alias("circles"))
    return n.crossJoin(over).crossJoin(top).crossJoin(first).select("circles", "overlapping", F.expr("largest = richest").alias("largest_first"))


# -- statistics -------------------------------------------------------------------------


@query(""", e AS (SELECT iso3c, arg_min(gdp, year) AS v0, arg_max(gdp, year) AS v1, max(year) - min(year) AS s FROM panel WHERE gdp > 0 GROUP BY 1 HAVING max(year) > min(year)),
t AS (SELECT (ln(v1) - ln(v0)) / s AS g, ln(v0) AS x, s FROM e),
f AS (SELECT regr_slope(g, x) AS beta, regr_sxx(g, x) AS sxx, regr_syy(g, x) AS syy, regr_sxy(g, x) AS sxy, count(*) AS n, avg(s) AS span FROM t),
h AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se, CASE WHEN beta < 0 AND 1 + beta * span > 0 THEN -ln(1 + beta * span) / span END AS speed FROM f)
SELECT round(se, 8) AS std_error, round(beta / se, 6) AS t_value, round(speed, 8) AS speed, round(ln(2) / speed, 5) AS half_life FROM h""")
def beta_errors(spark, sf):
    out = stats.beta_convergence(fx.panel(spark, sf), "gdp")
    return out.select(r6("std_error", 8).alias("std_error"), r6("t_value").alias("t_value"), r6("speed", 8).alias("speed"), r6("half_life", 5).alias("half_life"))


@query(_LATEST + "SELECT round(sum(pop * gdp * ln(gdp / m)) / sum(pop * gdp), 8) AS theil FROM c, (SELECT sum(pop * gdp) / sum(pop) AS m FROM c)")
def theil_weighted(spark, sf):
    return aggregate.theil(fx.panel(spark, sf).where("year = 2000"), "gdp", "pop").select(r6("theil", 8).alias("theil"))


_PERMUTED = _LATEST + """, sym AS (SELECT iso3c_a AS a, iso3c_b AS b FROM edges UNION SELECT iso3c_b, iso3c_a FROM edges), k AS (SELECT a, b FROM sym WHERE a IN (SELECT iso3c FROM c) AND b IN (SELECT iso3c FROM c)),
d AS (SELECT iso3c, gdp AS v, row_number() OVER (ORDER BY iso3c) AS i FROM c WHERE iso3c IN (SELECT a FROM k)),
p AS (SELECT perm, iso3c, CASE WHEN perm = 0 THEN i ELSE row_number() OVER (PARTITION BY perm ORDER BY md5('1|' || perm || '|' || iso3c)) END AS j FROM d, range(100) r(perm)),
z AS (SELECT perm, p.iso3c, v - avg(v) OVER () AS z FROM p JOIN d ON j = i), n AS (SELECT z.perm, a, avg(z) AS zn FROM k JOIN z ON b = iso3c GROUP BY 1, 2),
m AS (SELECT z.perm, sum(z * zn) / sum(z * z) AS v FROM z JOIN n ON n.perm = z.perm AND a = iso3c GROUP BY 1)
SELECT round((1 + count(*) FILTER (WHERE perm > 0 AND v >= seen)) / 100.0, 6) AS p_value FROM m, (SELECT v AS seen FROM m WHERE perm = 0)"""


@query(_PERMUTED)
def morans_p_value(spark, sf):
    edges = spatial.country_borders(fx.ring(spark))
    return stats.morans_i(fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp"), "gdp", edges, n_perm=99).select(r6("p_value").alias("p_value"))


@query(_LATEST + """, x AS (SELECT gdp, row_number() OVER (ORDER BY gdp) AS i, sum(gdp) OVER (ORDER BY gdp) AS s, sum(gdp * gdp) OVER (ORDER BY gdp) AS q FROM (SELECT DISTINCT gdp FROM c)), n AS (SELECT max(i) AS n, max(s) AS s, max(q) AS q FROM x),
cuts AS (SELECT a.gdp AS u, b.gdp AS v, a.q - a.s * a.s / a.i + (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.i - a.i) + (n.q - b.q) - (n.s - b.s) * (n.s - b.s) / (n.n - b.i) AS cost FROM x a JOIN x b ON a.i < b.i, n WHERE b.i < n.n),
best AS (SELECT u, v FROM cuts ORDER BY cost LIMIT 1)
SELECT iso3c, CAST(1 + (gdp > u)::INT + (gdp > v)::INT AS INTEGER) AS bin FROM c, best""")
def natural_bins(spark, sf):
    c = fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp")
    return viz_prep.world_map(c, "gdp", "jenks", 3).select("iso3c", "bin")


# -- tables, joins, sources -----------------------------------------------------------------


@query(""", x AS (SELECT iso3c, sum(CAST(gdp AS DECIMAL(38,2))) AS v FROM panel GROUP BY 1), y AS (SELECT iso3c, count(*) AS v FROM holes GROUP BY 1)
SELECT iso3c, CAST(x.v AS DOUBLE) AS "v.x", y.v AS "v.y" FROM x LEFT JOIN y USING (iso3c)""")
def join_suffixes(spark, sf):
    x = fx.panel(spark, sf).groupBy("iso3c").agg(F.sum(F.col("gdp").cast("decimal(38,2)")).cast("double").alias("v"))
    return joins.spine_join(x, fx.holes(spark, sf).groupBy("iso3c").agg(F.count(F.lit(1)).alias("v")))


@query(_LATEST + "SELECT iso3c, continent, region FROM (SELECT DISTINCT iso3c FROM c) JOIN spine USING (iso3c), (VALUES ('FRA', 'Europe & Central Asia'), ('KEN', 'Sub-Saharan Africa'), ('USA', 'North America'), ('IND', 'South Asia')) r(code, region) WHERE code = iso3c")
def classification(spark, sf):
    df = fx.panel(spark, sf).where("year = 2000").select("iso3c").where(F.col("iso3c").isin("FRA", "KEN", "USA", "IND"))
    return world.country_classification(df)


def _indicator_root(spark, sf) -> str:
    """Two indicators written as a source keeps them: G (holes), P (panel without 1999)."""
    root = new_folder(spark, "indicators")
    names = fx.spine(spark).select("iso3c", "iso2c", F.trim("messy_name").alias("country"))
    for code, df, value in (("G", fx.holes(spark, sf), "gdp"), ("P", fx.panel(spark, sf).where("year <> 1999"), "pop")):
        df.join(F.broadcast(names), "iso3c").select("iso3c", "iso2c", "country", "year", F.col(value).cast("double").alias("value")).write.parquet(f"{root}/{code}")
    return root


@query("SELECT iso3c, year, h.gdp AS gdp, CAST(p.pop AS DOUBLE) AS pop FROM (SELECT * FROM holes WHERE year BETWEEN 1996 AND 2000) h FULL JOIN (SELECT iso3c, year, pop FROM panel WHERE year <> 1999 AND year BETWEEN 1996 AND 2000) p USING (iso3c, year)")
def country_panel(spark, sf):
    out = world.country_data(spark, _indicator_root(spark, sf), list(range(1996, 2001)), {"gdp": "G", "pop": "P"}, panel=True)
    return out.select("iso3c", "year", "gdp", "pop")


@query("SELECT iso3c, continent, arg_max(gdp, year) FILTER (WHERE gdp IS NOT NULL) AS gdp FROM holes JOIN spine USING (iso3c) WHERE year BETWEEN 1995 AND 1998 GROUP BY 1, 2")
def country_latest(spark, sf):
    return world.country_data(spark, _indicator_root(spark, sf), 1998, {"gdp": "G"}, latest=True, lookback_years=3).select("iso3c", "continent", "gdp")


@query('SELECT iso3c, "group", "order", long, lat, CAST(pop AS DOUBLE) AS pop FROM ring LEFT JOIN (SELECT iso3c, pop FROM panel WHERE year = 1998) USING (iso3c)')
def world_frame(spark, sf):
    return world.world_data(spark, _indicator_root(spark, sf), 1998, {"pop": "P"}, geometry=fx.ring(spark)).select("iso3c", "group", "order", "long", "lat", "pop")


@query("SELECT 'G' AS code, iso3c, year, gdp AS value FROM holes WHERE year >= 1997")
def indicator_source(spark, sf):
    indicators.register(spark)
    got = spark.read.format("indicators").option("codes", "G,missing").load(_indicator_root(spark, sf))
    return got.where("year >= 1997").select("code", "iso3c", "year", "value")


@query("SELECT iso3c, count(*) AS n FROM people GROUP BY 1")
def standardized_stream(spark, sf):
    base = fx.table(spark, sf, "customer")
    stream = spark.readStream.schema(base.schema).parquet(f"{sf}/customer.parquet*").join(F.broadcast(fx.spine(spark).select("n_nationkey", "messy_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    name = f"stream_{uuid.uuid4().hex}"
    run = standardize_stream(stream, "messy_name", add=()).select("iso3c").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).groupBy("iso3c").agg(F.count(F.lit(1)).alias("n"))
