"""Registered queries of lookups, projections and outlines over every customer.

Expected codes and places are written out or follow from closed formulas; each
customer has one of them, or a place, square or name of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, r6
from .catalog_more import _ANGLES, _PLANE, _ROBINSON, _SOLVED, SPELLINGS
from .functions.geo import in_ring, project
from .operators import diagnostics, resolve, spatial, viz_prep
from .plans import fixtures as fx
from .refdata import common_indicators, historical_codes, indicator_search
from .sinks.export import wkb_frame
from .sources import world
from .sources.geometry import world_geometry


def each(rows, names: str, select: str = "*"):
    """A query whose rows are spread over customers: SQL side."""
    return query(", z AS (SELECT 1) " + fx.spread_sql(rows, names, select))


# -- resolution ---------------------------------------------------------------------


@each(SPELLINGS, "name, iso3c")
def resolve_spellings(spark, sf):
    return resolve.resolved(fx.spread(spark, sf, [(n,) for n, _ in SPELLINGS], "name string"), "name")


# Codes and what they stand for.
_SCHEMES = [("FRA", 250, 250, "Western Europe", "Europe"), ("BRA", 76, 76, "South America", "Americas"), ("KEN", 404, 404, "Eastern Africa", "Africa"), ("JPN", 392, 392, "Eastern Asia", "Asia"),
            ("USA", 840, 840, "Northern America", "Americas"), ("NZL", 554, 554, "Australasia", "Oceania"), ("TWN", 158, None, "Eastern Asia", None), ("XKX", None, None, "Southern Europe", None)]
_NUMBERS = [(12, "DZA"), (32, "ARG"), (76, "BRA"), (124, "CAN"), (818, "EGY"), (231, "ETH"), (250, "FRA"), (276, "DEU"), (356, "IND"), (360, "IDN"), (999, None)]
_LOCAL = [("France", "France", "Frankreich", "Francia"), ("Germany", "Allemagne", "Deutschland", "Alemania"), ("Spain", "Espagne", "Spanien", "España"), ("Japan", "Japon", "Japan", "Japón"), ("Wakanda", None, None, None)]
_OVERRIDES = [("Madeira", "PRT"), ("Azores", "PRT"), ("Saba", "BES"), ("Bonaire", "BES"), ("Barbuda", "ATG"), ("Canary Islands", "ESP"), ("Siachen Glacier", "IND"), ("Channel Islands", "GBR"), ("Ascension Island", "SHN"), ("Micronesia", "FSM"), ("Saint Martin", "MAF"), ("Kosovo", "XKX")]
_SUGGESTED = [("Germny", False, "Germany"), ("Brzil", False, "Brazil"), ("Frnace", False, "France"), ("Kenia", False, "Kenya"), ("Peruu", False, "Peru"), ("France", True, None), ("zzzzqq", False, None)]
_INCOMES = [("High income", "High income", 5), (" Low income ", "Low income", 2), ("Not classified", "Not classified", 1), ("Rich", None, None), (None, None, None)]
_CLASSES = [(1.0, 1, "[1,3]"), (3.0, 1, "[1,3]"), (3.5, 2, "(3,5]"), (5.0, 2, "(3,5]"), (9.0, None, None), (None, None, None)]


@each(_SCHEMES, "iso3c, iso3n, un, region23, un_region")
def code_schemes(spark, sf):
    return resolve.with_attributes(fx.spread(spark, sf, [(r[0],) for r in _SCHEMES], "iso3c string"), ["iso3n", "un", "region23", "un_region"])


@each(_NUMBERS, "n, iso3c")
def convert_from_numeric(spark, sf):
    return resolve.convert_country(fx.spread(spark, sf, [(n,) for n, _ in _NUMBERS], "n int"), "n", "iso3c", origin="iso3n")


@each(_LOCAL, "name, fr, de, es")
def localized_name(spark, sf):
    df = fx.spread(spark, sf, [(r[0],) for r in _LOCAL], "name string")
    for language in ("fr", "de", "es"):
        df = resolve.convert_country(df, "name", f"name_{language}", out=language)
    return df


@each([("Kosovo", "XK", "XKX", "Europe", "🇽🇰"), ("XKX", None, None, None, None)], "name, iso2c, iso3c, continent, flag")
def kosovo(spark, sf):
    df = resolve.standardize_country(fx.spread(spark, sf, [("Kosovo",), ("XKX",)], "name string"), "name", add=("iso2c", "continent"))
    return resolve.convert_country(df, "name", "flag").select("c_custkey", "name", "iso2c", "iso3c", "continent", "flag")


@each(_OVERRIDES, "input, iso3c")
def override_codes(spark, sf):
    return resolve.resolved(fx.spread(spark, sf, [(n,) for n, _ in _OVERRIDES], "input string"), "input")


@each(_SUGGESTED, "input, matched, suggestion")
def match_suggestions(spark, sf):
    df = fx.spread(spark, sf, [(n,) for n, *_ in _SUGGESTED], "name string")
    found = diagnostics.check_country_match(df.select("name").distinct(), "name").select("input", "matched", "suggestion")
    return df.join(F.broadcast(found), F.col("name") == F.col("input")).select("c_custkey", "input", "matched", "suggestion")


@each(_INCOMES, "label, income, place")
def income_levels(spark, sf):
    df = fx.spread(spark, sf, [(r[0],) for r in _INCOMES], "label string").withColumn("income", world.clean_income(F.col("label")))
    return df.withColumn("place", world.income_rank(F.col("income")))


@each(_CLASSES, "v, bin, bin_label")
def class_labels(spark, sf):
    return viz_prep.classified(fx.spread(spark, sf, [(r[0],) for r in _CLASSES], "v double"), "v", [1.0, 3.0, 5.0])


_TYPOS = [("Germny",), ("Brzil",), ("Frnace",), ("Wakanda",), ("Kenia",), ("Marocco",), ("Peruu",)]


@query(f""", typos AS ({fx.spread_sql(_TYPOS, 'input')}), near AS (SELECT input, arg_min(name, d * 1000 + n_nationkey) AS suggestion, min(d) AS dist FROM (
  SELECT input, n_nationkey, trim(messy_name) AS name, CAST(levenshtein(input, trim(messy_name)) AS DOUBLE) AS d FROM (SELECT DISTINCT input FROM typos), spine) GROUP BY 1)
SELECT c_custkey, input, suggestion, dist FROM typos JOIN near USING (input)""")
def nearest_name_edit(spark, sf):
    typos = fx.spread(spark, sf, _TYPOS, "input string")
    names = fx.spine(spark).select(F.col("n_nationkey").alias("ord"), F.trim("messy_name").alias("name"))
    return typos.join(F.broadcast(diagnostics.nearest_names(typos, names, "edit")), "input").select("c_custkey", "input", "suggestion", F.col("distance").alias("dist"))


# -- reference tables met by customers' nations -----------------------------------------


@query("SELECT iso3c, iso2c, count(*) AS n FROM people JOIN spine USING (iso3c) GROUP BY ALL")
def country_codes(spark, sf):
    from .refdata import country_codes as codes

    who = resolve.resolved(fx.people(spark, sf), "country").groupBy("iso3c").agg(F.count(F.lit(1)).alias("n"))
    return who.join(F.broadcast(codes(spark, ["iso3c", "iso2c", "no_such"])), "iso3c").select("iso3c", "iso2c", "n")


# Which of the nations' countries are in a group.
_MEMBERS = [
    ("EU", "FRA"), ("EU", "DEU"), ("EU", "ROU"), ("EuroZone", "FRA"), ("EuroZone", "DEU"), ("G7", "CAN"), ("G7", "FRA"), ("G7", "DEU"), ("G7", "JPN"), ("G7", "GBR"), ("G7", "USA"),
    ("G20", "ARG"), ("G20", "BRA"), ("G20", "CAN"), ("G20", "CHN"), ("G20", "FRA"), ("G20", "DEU"), ("G20", "IND"), ("G20", "IDN"), ("G20", "JPN"), ("G20", "RUS"), ("G20", "SAU"), ("G20", "GBR"), ("G20", "USA"),
    ("BRICS", "BRA"), ("BRICS", "RUS"), ("BRICS", "IND"), ("BRICS", "CHN"), ("ASEAN", "IDN"), ("ASEAN", "VNM"), ("GCC", "SAU"), ("Mercosur", "ARG"), ("Mercosur", "BRA"),
]
_SHOWN = sorted({g for g, _ in _MEMBERS})


@query(f', m("group", iso3c) AS (VALUES {fx.values(_MEMBERS)}) SELECT "group", iso3c, count(*) AS n FROM people JOIN m USING (iso3c) GROUP BY ALL')
def country_groups(spark, sf):
    from .refdata import country_groups as groups

    who = resolve.resolved(fx.people(spark, sf), "country")
    return who.join(F.broadcast(groups(spark).where(F.col("group").isin(_SHOWN))), "iso3c").groupBy("group", "iso3c").agg(F.count(F.lit(1)).alias("n"))


@query(f', m("group", iso3c) AS (VALUES {fx.values(_MEMBERS)}) SELECT "group", count(DISTINCT c_custkey) AS n, round(CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE), 2) AS balance FROM people JOIN m USING (iso3c) GROUP BY ALL')
def group_sizes(spark, sf):
    from .refdata import country_groups as groups

    who = resolve.resolved(fx.people(spark, sf), "country")
    met = who.join(F.broadcast(groups(spark).where(F.col("group").isin(_SHOWN))), "iso3c")
    return met.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("balance").cast("decimal(18,2)")).cast("double"), 2).alias("balance"))


@query(f", m(g, iso3c) AS (VALUES {fx.values(_MEMBERS)}) SELECT c_custkey, iso3c FROM people JOIN m USING (iso3c) WHERE g = 'G20'")
def group_members(spark, sf):
    from .refdata import country_groups as groups

    return resolve.resolved(fx.people(spark, sf), "country").join(F.broadcast(groups(spark, "G20").select("iso3c")), "iso3c").select("c_custkey", "iso3c")


# Dissolved entities, the year, and successors.
_ENTITIES = [
    ("Soviet Union", 1991, "ARM AZE BLR EST GEO KAZ KGZ LTU LVA MDA RUS TJK TKM UKR UZB"), ("Yugoslavia", 1992, "BIH HRV MKD MNE SRB SVN XKX"), ("Serbia and Montenegro", 2006, "MNE SRB XKX"), ("Czechoslovakia", 1993, "CZE SVK"), ("East Germany", 1990, "DEU"),
    ("Netherlands Antilles", 2010, "BES CUW SXM"), ("North Yemen", 1990, "YEM"), ("South Yemen", 1990, "YEM"), ("Sudan (former)", 2011, "SDN SSD"), ("United Arab Republic", 1961, "EGY SYR"), ("Tanganyika", 1964, "TZA"), ("Zanzibar", 1964, "TZA"),
    ("North Vietnam", 1976, "VNM"), ("South Vietnam", 1976, "VNM"),
]
_OLD = f", old(i, historical, dissolved, codes) AS (VALUES {fx.values([(i, *e) for i, e in enumerate(_ENTITIES)])}), o AS (SELECT c_custkey, historical, dissolved, codes FROM customer JOIN old ON c_custkey % {len(_ENTITIES)} = i) "


def _old_names(spark, sf):
    return fx.spread(spark, sf, [(e[0],) for e in _ENTITIES], "historical string")


@query(_OLD + "SELECT c_custkey, historical, dissolved, unnest(string_split(codes, ' ')) AS iso3c FROM o")
def historical_table(spark, sf):
    return _old_names(spark, sf).join(F.broadcast(historical_codes(spark).select("historical", "dissolved", "iso3c")), "historical").select("c_custkey", "historical", "dissolved", "iso3c")


@query(_OLD + "SELECT historical, dissolved, CAST(sum(len(string_split(codes, ' '))) AS BIGINT) AS n FROM o GROUP BY ALL")
def historical_entities(spark, sf):
    return _old_names(spark, sf).join(F.broadcast(historical_codes(spark)), "historical").groupBy("historical", "dissolved").agg(F.count(F.lit(1)).alias("n"))


@query(_OLD + "SELECT input, dissolved, iso3c, count(*) AS n FROM (SELECT historical AS input, dissolved, unnest(string_split(codes, ' ')) AS iso3c FROM o WHERE historical <> 'Sudan (former)') GROUP BY ALL")
def successors(spark, sf):
    names = _old_names(spark, sf).where("historical <> 'Sudan (former)'")
    after = diagnostics.dissolve_country(names.select("historical").distinct(), "historical").select("input", "dissolved", "iso3c")
    return names.join(F.broadcast(after), F.col("historical") == F.col("input")).groupBy("input", "dissolved", "iso3c").agg(F.count(F.lit(1)).alias("n"))


# An indicator's code and whether its name speaks of gdp.
_CATALOGUE = [("NY.GDP.MKTP.CD", True), ("NY.GDP.MKTP.KD", True), ("NY.GDP.PCAP.KD", True), ("NY.GDP.PCAP.CD", True), ("SH.XPD.CHEX.GD.ZS", True), ("SP.POP.TOTL", False), ("SP.DYN.LE00.IN", False)]


@each(_CATALOGUE, "indicator, found")
def indicator_catalogue(spark, sf):
    hits = indicator_search(common_indicators(spark).select(F.col("code").alias("indicator"), F.col("description").alias("name")), "gdp").select("indicator", F.lit(True).alias("hit"))
    asked = fx.spread(spark, sf, [(c,) for c, _ in _CATALOGUE], "indicator string")
    return asked.join(F.broadcast(hits), "indicator", "left").select("c_custkey", "indicator", F.coalesce("hit", F.lit(False)).alias("found"))


# -- projections of every customer's place ------------------------------------------------

_HAVERSINE = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b1} - {b0}) / 2), 2) + cos(radians({b0})) * cos(radians({b1})) * pow(sin(radians({a1} - {a0}) / 2), 2))))"


def _projected(spark, sf, *names, digits=8):
    out = None
    for n in names:
        one = fx.spots(spark, sf).select(F.lit(n).alias("projection"), "c_custkey", project(F.col("lon"), F.col("lat"), n).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out.select("projection", "c_custkey", r6("p.x", digits).alias("x"), r6("p.y", digits).alias("y"))


@query("SELECT 'mercator' AS projection, c_custkey, round(radians(lon), 8) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)), 8) AS y FROM spots")
def project_mercator(spark, sf):
    return _projected(spark, sf, "mercator")


@query("SELECT 'lambert_cylindrical' AS projection, c_custkey, round(radians(lon), 8) AS x, round(sin(radians(lat)), 8) AS y FROM spots")
def project_cylindrical(spark, sf):
    return _projected(spark, sf, "lambert_cylindrical")


@query(_SOLVED + """SELECT projection, c_custkey, round(x, 6) AS x, round(y, 6) AS y FROM (
SELECT 'mollweide' AS projection, c_custkey, 2 * sqrt(2) / pi() * l * cos(m) AS x, sqrt(2) * sin(m) AS y FROM solved UNION ALL
SELECT 'eckert4', c_custkey, 2 / sqrt(pi() * (4 + pi())) * l * (1 + cos(e)), 2 * sqrt(pi() / (4 + pi())) * sin(e) FROM solved)""")
def project_iterated(spark, sf):
    return _projected(spark, sf, "mollweide", "eckert4", digits=6)


@query("SELECT 'laea' AS projection, c_custkey, round(k * cos(p) * sin(l), 7) AS x, round(k * sin(p), 7) AS y FROM (SELECT c_custkey, radians(lon) AS l, radians(lat) AS p, sqrt(2 / (1 + cos(radians(lat)) * cos(radians(lon)))) AS k FROM spots)")
def project_azimuthal(spark, sf):
    return _projected(spark, sf, "laea", digits=7)


_BY_CUSTOMER = _ANGLES.replace("iso3c", "c_custkey").replace("FROM geo", "FROM spots")


@query(" UNION ALL ".join(f"SELECT '{name}' AS projection, c_custkey, round({x}, 7) AS x, round({y}, 7) AS y FROM ({_BY_CUSTOMER})" for name, (x, y) in _PLANE.items()))
def project_closed_forms(spark, sf):
    return _projected(spark, sf, *_PLANE, digits=7)


@each([(float(a), float(kx), float(ky)) for a, kx, ky in _ROBINSON], "lat, kx, ky", "CAST(lat AS DOUBLE) AS lat, round(0.8487 * kx * radians(c_custkey % 180), 6) AS x, round(1.3523 * CAST(ky AS DOUBLE), 6) AS y")
def project_robinson(spark, sf):
    df = fx.spread(spark, sf, [(float(a),) for a, *_ in _ROBINSON], "lat double")
    p = project((F.col("c_custkey") % 180).cast("double"), F.col("lat"), "robinson")
    return df.select("c_custkey", "lat", r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


@query("""SELECT c_custkey, round(cos(radians(lat)) * sin(radians(lon - 10)), 8) AS x, round(cos(radians(20)) * sin(radians(lat)) - sin(radians(20)) * cos(radians(lat)) * cos(radians(lon - 10)), 8) AS y,
 sin(radians(20)) * sin(radians(lat)) + cos(radians(20)) * cos(radians(lat)) * cos(radians(lon - 10)) >= 0 AS visible FROM spots""")
def globe_view(spark, sf):
    out = viz_prep.globe_view(fx.spots(spark, sf).withColumnRenamed("lon", "long"), 10.0, 20.0)
    return out.select("c_custkey", r6("x", 8).alias("x"), r6("y", 8).alias("y"), "visible")


@query("SELECT c_custkey, a.iso3c AS a, b.iso3c AS b, round(" + _HAVERSINE.format(a0="ga.lon", b0="ga.lat", a1="gb.lon", b1="gb.lat") + ", 6) AS distance_km FROM customer JOIN spine a ON c_nationkey = a.n_nationkey JOIN spine b ON (c_nationkey + c_custkey) % 25 = b.n_nationkey JOIN geo ga ON ga.iso3c = a.iso3c JOIN geo gb ON gb.iso3c = b.iso3c")
def distance_between(spark, sf):
    s = fx.spine(spark)
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey", ((F.col("c_nationkey") + F.col("c_custkey")) % 25).alias("other"))
    pairs = c.join(F.broadcast(s.select(F.col("n_nationkey").alias("c_nationkey"), F.col("iso3c").alias("a"))), "c_nationkey").join(F.broadcast(s.select(F.col("n_nationkey").alias("other"), F.col("iso3c").alias("b"))), "other")
    return spatial.distance_between(pairs.select("c_custkey", "a", "b"), "a", "b", fx.geo(spark)).withColumn("distance_km", r6("distance_km"))


@query("SELECT line, ord, long, lat, n FROM (SELECT 'm' || (x * 30 - 180) AS line, CAST(i AS INTEGER) AS ord, CAST(x * 30 - 180 AS DOUBLE) AS long, i * 2.5::DOUBLE - 90 AS lat FROM range(13) t(x), range(73) r(i)) JOIN (SELECT CAST(round(lon / 30) * 30 AS DOUBLE) AS long, count(*) AS n FROM spots GROUP BY 1) USING (long)")
def graticule(spark, sf):
    near = fx.spots(spark, sf).groupBy((F.round(F.col("lon") / 30) * 30).alias("_m")).agg(F.count(F.lit(1)).alias("n"))
    lines = spatial.graticule(spark, 30).where("line like 'm%'")
    return lines.join(near, F.col("long") == F.col("_m")).select("line", "ord", "long", "lat", "n")


# -- outlines: every customer's square ----------------------------------------------------

_NEXT = """, v AS (SELECT iso3c, "group", long, lat, coalesce(lead(long) OVER w, first_value(long) OVER w) AS nlon, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS nlat FROM lots WINDOW w AS (PARTITION BY "group" ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT iso3c, "group", abs(sum(radians(nlon - long) * (2 + sin(radians(lat)) + sin(radians(nlat))))) * 6371.0088 * 6371.0088 / 2 AS area FROM v GROUP BY 1, 2) """


@query(_NEXT + 'SELECT iso3c, "group", round(area, 3) AS area_km2 FROM a')
def ring_area(spark, sf):
    return spatial.ring_areas(fx.lots(spark, sf)).withColumn("area_km2", r6("area_km2", 3))


@query(_NEXT + "SELECT iso3c, round(sum(area), 3) AS area_km2 FROM a GROUP BY 1")
def country_areas(spark, sf):
    return spatial.country_areas(fx.lots(spark, sf)).withColumn("area_km2", r6("area_km2", 3))


_MIDDLES = _NEXT + """, m AS (SELECT "group", (min(long) + max(long)) / 2 AS lon, (min(lat) + max(lat)) / 2 AS lat FROM lots GROUP BY 1),
c AS (SELECT iso3c, round(arg_max(lon, (round(area, 6), -"group")), 6) AS lon, round(arg_max(lat, (round(area, 6), -"group")), 6) AS lat FROM a JOIN m USING ("group") GROUP BY 1) """


@query(_MIDDLES + "SELECT * FROM c")
def polygon_centroids(spark, sf):
    return spatial.polygon_centroids(fx.lots(spark, sf)).select("iso3c", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query(_MIDDLES + "SELECT c.iso3c, lon, lat, chr(127397 + ascii(iso2c)) || chr(127397 + ascii(substr(iso2c, 2))) AS flag FROM c JOIN spine USING (iso3c)")
def country_labels(spark, sf):
    return viz_prep.label_points(fx.lots(spark, sf), flags=True).select("iso3c", r6("lon").alias("lon"), r6("lat").alias("lat"), "flag")


@query("SELECT iso3c_a, iso3c_b FROM shared")
def country_borders(spark, sf):
    return spatial.country_borders(fx.mesh(spark, sf))


@query("SELECT iso3c, neighbor FROM (SELECT iso3c_a AS iso3c, iso3c_b AS neighbor FROM shared UNION SELECT iso3c_b, iso3c_a FROM shared) WHERE iso3c IN ('FRA', 'JPN', 'USA')")
def neighbors(spark, sf):
    return spatial.neighbors(spatial.country_borders(fx.mesh(spark, sf)), ["France", "Japan", "U.S."])


@query("SELECT iso3c_a, iso3c_b FROM shared")
def touching_mesh(spark, sf):
    return spatial.touching(fx.mesh(spark, sf), step=4.0)


_EDGES = """SELECT {by}least(a, b).x AS x0, least(a, b).y AS y0, greatest(a, b).x AS x1, greatest(a, b).y AS y1 FROM (SELECT {by}{{'x': long, 'y': lat}} AS a,
{{'x': coalesce(lead(long) OVER w, first_value(long) OVER w), 'y': coalesce(lead(lat) OVER w, first_value(lat) OVER w)}} AS b FROM mesh {join} WINDOW w AS (PARTITION BY "group" ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("SELECT x0, y0, x1, y1 FROM (" + _EDGES.format(by="", join="") + ") GROUP BY ALL HAVING count(*) = 1")
def coastline(spark, sf):
    return world_geometry(fx.mesh(spark, sf), "coastline")


@query("SELECT continent, count(*) AS edges FROM (SELECT continent FROM (" + _EDGES.format(by="continent, ", join="JOIN spine USING (iso3c)") + ") GROUP BY continent, x0, y0, x1, y1 HAVING count(*) % 2 = 1) GROUP BY 1")
def dissolved_outlines(spark, sf):
    frame = fx.mesh(spark, sf).join(F.broadcast(fx.spine(spark).select("iso3c", "continent")), "iso3c")
    return spatial.dissolve(frame, "continent").groupBy("continent").agg(F.count(F.lit(1)).alias("edges"))


@query('SELECT iso3c, "group", "order", round(long, 6) AS long, round(lat, 6) AS lat FROM lots WHERE long BETWEEN -15.005 AND 35.005 AND lat BETWEEN -20.005 AND 30.005')
def region_box(spark, sf):
    out = fx.lots(spark, sf).where(resolve.region_predicate(spark, [-15.005, -20.005, 35.005, 30.005]))
    return out.withColumns({"long": r6("long"), "lat": r6("lat")})


@query('SELECT "group", round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1 FROM (SELECT "group", greatest(-15.005, least(42.005, long)) AS x, greatest(-34.005, least(39.005, lat)) AS y FROM lots) GROUP BY 1 HAVING min(x) < max(x) AND min(y) < max(y)')
def clipped_rings(spark, sf):
    out = spatial.clip_box(fx.lots(spark, sf), -15.005, -34.005, 42.005, 39.005).groupBy("group").agg(*[r6(f(c)).alias(n) for n, f, c in (("x0", F.min, "long"), ("x1", F.max, "long"), ("y0", F.min, "lat"), ("y1", F.max, "lat"))])
    return out.where("x0 < x1 and y0 < y1")


@query("SELECT iso3c, \"group\", \"order\", round(radians(long), 8) AS long, round(sin(radians(lat)), 8) AS lat FROM lots JOIN spine USING (iso3c) WHERE continent = 'Europe' AND abs(long) < 180")
def projected_region(spark, sf):
    out = world_geometry(fx.lots(spark, sf).where("abs(long) < 180"), region="Europe", projection="lambert_cylindrical")
    return out.select("iso3c", "group", "order", r6("long", 8).alias("long"), r6("lat", 8).alias("lat"))


@query("SELECT CAST(4 + count(*) AS BIGINT) AS vertices, count(*) AS holes, round(min(long), 6) AS west FROM lots")
def ocean_with_holes(spark, sf):
    out = world_geometry(fx.lots(spark, sf), "ocean")
    return out.agg(F.count(F.lit(1)).alias("vertices"), F.sum(F.col("hole").cast("long")).alias("holes"), r6(F.min(F.when(F.col("hole"), F.col("long")))).alias("west"))


@query("SELECT iso3c, CAST(9 + 93 * count(*) AS INTEGER) AS bytes, '0106000000' AS head FROM spots GROUP BY 1")
def well_known_binary(spark, sf):
    return wkb_frame(fx.mesh(spark, sf)).select("iso3c", F.octet_length("geometry").alias("bytes"), F.substring(F.hex("geometry"), 1, 10).alias("head"))


_DENTED = [(0, 0), (0.5, 0.00625), (1, 0), (1.00625, 0.5), (1, 1), (0.5, 0.99375), (0, 1), (0.00625, 0.5)]


def _customers_ring(spark, sf, points):
    """A ring of (x, y) to the north-east of every customer's square in a wide mesh."""
    k = F.col("c_custkey")
    corners = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate(points, 1)])
    rows = fx.spots(spark, sf).select("iso3c", k.cast("int").alias("group"), (k % 40 * 4).alias("u"), F.expr("c_custkey div 40 * 4").alias("v"), F.explode(corners).alias("p"))
    return rows.select("iso3c", "group", "p.order", (F.col("u") + F.col("p.x")).alias("long"), (F.col("v") + F.col("p.y")).alias("lat"))


@query('SELECT CAST(c_custkey AS INTEGER) AS "group", 4::BIGINT AS n, CAST(c_custkey % 40 * 4 AS DOUBLE) AS west, CAST(c_custkey % 40 * 4 + 1 AS DOUBLE) AS east FROM customer')
def simplified_rings(spark, sf):
    out = spatial.simplify_geometry(_customers_ring(spark, sf, _DENTED), 0.4)
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("long").alias("west"), F.max("long").alias("east"))


@query("SELECT CAST(c_custkey AS INTEGER) AS g, s AS side, CAST(x AS DOUBLE) AS long, round(lat + dy, 6) AS lat FROM spots, (VALUES (0, 170, 0), (0, 180, 0), (0, 180, 10), (0, 170, 10), (1, -180, 0), (1, -180, 10), (1, -170, 0), (1, -170, 10)) t(s, x, dy)")
def antimeridian(spark, sf):
    corners = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate([(170, 0), (-170, 0), (-170, 10), (170, 10), (170, 0)], 1)])
    frame = fx.spots(spark, sf).select("iso3c", F.col("c_custkey").cast("int").alias("group"), "lat", F.explode(corners).alias("p")).select("iso3c", "group", "p.order", F.col("p.x").alias("long"), (F.col("lat") + F.col("p.y")).alias("lat"))
    out = spatial.split_antimeridian(frame)
    return out.select(F.expr("`group` div 2").cast("int").alias("g"), (F.col("group") % 2).alias("side"), "long", r6("lat").alias("lat")).distinct()


# Squares that lie on part of a side, on a corner, across, and apart.
_SIDES = [("A", 0, 0, 4, 4), ("B", 4, 1, 6, 3), ("C", 6, 3, 8, 5), ("D", 7, 4, 9, 4.5), ("E", 0, 10, 1, 11)]


@query("SELECT n_nationkey || a AS iso3c_a, n_nationkey || b AS iso3c_b FROM spine, (VALUES ('A', 'B'), ('B', 'C'), ('C', 'D')) t(a, b) WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def touching_outlines(spark, sf):
    boxes = F.array(*[F.struct(F.lit(c).alias("c"), *[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), box)]) for c, *box in _SIDES])
    n = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")).distinct().select("n", F.posexplode(boxes).alias("i", "b"))
    corners = F.array(*[F.struct(F.lit(k).alias("order"), (F.col(f"b.{x}") + F.col("n") * 20).alias("long"), F.col(f"b.{y}").alias("lat")) for k, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")), 1)])
    rows = n.select(F.concat(F.col("n").cast("string"), "b.c").alias("iso3c"), (F.col("n") * 5 + F.col("i")).alias("group"), F.explode(corners).alias("p"))
    return spatial.touching(rows.select("iso3c", "group", "p.order", "p.long", "p.lat"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS iso3c, true AS inside, false AS middle_inside FROM customer")
def points_inside(spark, sf):
    """Every customer's U, whose middle lies outside of it."""
    shape = [(0, 0), (2.25, 0), (2.25, 2.25), (1.75, 2.25), (1.75, 0.5), (0.5, 0.5), (0.5, 2.25), (0, 2.25)]
    frame = _customers_ring(spark, sf, shape).withColumn("iso3c", F.col("group").cast("string"))
    shapes = spatial.rings(frame)
    inside = lambda x, y: in_ring(x, y, F.col("ring"))
    mid = spatial.polygon_centroids(frame).toDF("iso3c", "mx", "my")
    both = shapes.join(spatial.interior_points(frame), "iso3c").join(mid, "iso3c")
    return both.select("iso3c", inside(F.col("lon"), F.col("lat")).alias("inside"), inside(F.col("mx") + 0.001, F.col("my") + 0.001).alias("middle_inside"))


