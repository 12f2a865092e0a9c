"""Registered queries over the driver's tables, each with DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.geo import haversine_km
from .operators import aggregate, diagnostics, joins, panel, resolve, spatial, stats, viz_prep
from .plans import fixtures as fx
from .sources import indicators as ind

_QUERIES: dict = {}
_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL that may use the fixtures' CTEs."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = fx.CTE + sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# -- resolution -----------------------------------------------------------------


@query("""SELECT iso3c, year, round(gdp, 2) AS gdp, round(gdp / sum(gdp) OVER (PARTITION BY year), 8) AS gdp_share,
  CAST(rank() OVER (PARTITION BY year ORDER BY gdp DESC) AS INTEGER) AS rank FROM panel""")
def flagship_panel(spark, sf):
    p = fx.people(spark, sf)
    coded = resolve.resolved(p.select("country").distinct(), "country")
    per = fx.table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    who = p.join(F.broadcast(coded), "country").select("c_custkey", "iso3c")
    got = per.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("iso3c", "year").agg(F.sum("v").cast("double").alias("gdp"))
    out = panel.rank_countries(panel.share_of_world(got, "gdp"), "gdp", within="year")
    return out.select("iso3c", "year", r6("gdp", 2).alias("gdp"), r6("gdp_share", 8).alias("gdp_share"), "rank")


@query("SELECT c_custkey, iso3c, iso2c, continent FROM customer JOIN spine ON c_nationkey = n_nationkey")
def standardize_alias(spark, sf):
    return resolve.standardize_country(fx.people(spark, sf), "country", add=("iso2c", "continent")).select("c_custkey", "iso3c", "iso2c", "continent")


# Names and the codes they stand for.
_NAMED = [
    ("Ascension Island", "SHN"), ("Azores", "PRT"), ("Barbuda", "ATG"), ("Bonaire", "BES"), ("British Virgin Islands", "VGB"), ("Canary Islands", "ESP"), ("Chagos Archipelago", "IOT"),
    ("Channel Islands", "GBR"), ("Curacao", "CUW"), ("Federated States of Micronesia", "FSM"), ("Grenadines", "VCT"), ("Heard Island", "HMD"), ("Kosovo", "XKX"), ("Kosovo, Republic of", "XKX"),
    ("Madeira", "PRT"), ("Madeira Islands", "PRT"), ("Micronesia", "FSM"), ("Micronesia, Fed. Sts.", "FSM"), ("Saba", "BES"), ("Saint Barthelemy", "BLM"), ("Saint Martin", "MAF"),
    ("Siachen Glacier", "IND"), ("Sint Eustatius", "BES"), ("Virgin Islands", "VIR"), ("Virgin Islands, U.S.", "VIR"), ("Wakanda", None),
]


@query(f", z AS (SELECT 1) {fx.spread_sql(_NAMED, 'name, iso3c')}")
def standardize_override(spark, sf):
    return resolve.resolved(fx.spread(spark, sf, [(n,) for n, _ in _NAMED], "name string"), "name")


@query("SELECT c_custkey, iso3c FROM customer JOIN spine ON c_nationkey = n_nationkey")
def standardize_codes(spark, sf):
    return resolve.resolved(fx.people(spark, sf).withColumn("code", F.lower("iso")), "code", origin="iso2c").select("c_custkey", "iso3c")


@query("SELECT c_custkey, upper(trim(iso3c)) AS iso3c FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'zzz ' ELSE lower(iso3c) END AS iso3c FROM people)")
def standardize_iso3c(spark, sf):
    df = fx.people(spark, sf).join(F.broadcast(fx.spine(spark).select(F.col("messy_name").alias("country"), "iso3c")), "country")
    df = df.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("zzz ")).otherwise(F.lower("iso3c")).alias("code"))
    return resolve.resolved(df, "code", origin="iso3c").select("c_custkey", "iso3c")


@query("SELECT c_custkey, chr(127397 + ascii(iso)) || chr(127397 + ascii(substr(iso, 2))) AS flag FROM people")
def convert_country_flag(spark, sf):
    return resolve.convert_country(fx.people(spark, sf), "country", "flag").select("c_custkey", "flag")


@query("SELECT continent, count(*) AS n FROM people JOIN spine USING (iso3c) GROUP BY 1")
def convert_country_continent(spark, sf):
    return resolve.convert_country(fx.people(spark, sf), "iso", "continent", origin="iso2c").groupBy("continent").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, iso3c IN ('ARG', 'AUS', 'BRA', 'CAN', 'CHN', 'DEU', 'FRA', 'GBR', 'IDN', 'IND', 'ITA', 'JPN', 'KOR', 'MEX', 'RUS', 'SAU', 'TUR', 'USA', 'ZAF') AS in_group FROM people""")
def in_group(spark, sf):
    return resolve.in_group(fx.people(spark, sf), "country", "G20").select("c_custkey", "in_group")


@query("SELECT count(*) AS n FROM people JOIN spine USING (iso3c) WHERE continent = 'Europe'")
def region_filter(spark, sf):
    df = resolve.resolved(fx.people(spark, sf), "country")
    return df.where(resolve.region_predicate(spark, "Europe")).agg(F.count(F.lit(1)).alias("n"))


# -- joins ------------------------------------------------------------------------

_SIDES = """, x AS (SELECT iso3c, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS bal FROM customer JOIN spine ON c_nationkey = n_nationkey WHERE c_nationkey % 3 <> 0 GROUP BY 1),
y AS (SELECT iso3c, count(*) AS suppliers FROM supplier JOIN spine ON s_nationkey = n_nationkey WHERE s_nationkey % 4 <> 1 GROUP BY 1) """


def _sides(spark, sf):
    s = fx.spine(spark)
    x = fx.table(spark, sf, "customer").where("c_nationkey % 3 <> 0").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("bal")).join(F.broadcast(s), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("messy_name").alias("country"), "bal")
    y = fx.table(spark, sf, "supplier").where("s_nationkey % 4 <> 1").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers")).join(F.broadcast(s), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("iso2c").alias("code"), "suppliers")
    return x, y


def _joined(spark, sf, how):
    x, y = _sides(spark, sf)
    return joins.country_join(x, y, "country", "code", origin_y="iso2c", how=how).select("iso3c", F.col("bal").cast("double").alias("bal"), "suppliers")


@query(_SIDES + "SELECT x.iso3c, CAST(bal AS DOUBLE) AS bal, suppliers FROM x LEFT JOIN y USING (iso3c)")
def country_join_left(spark, sf):
    return _joined(spark, sf, "left")


@query(_SIDES + "SELECT iso3c, CAST(bal AS DOUBLE) AS bal, suppliers FROM x JOIN y USING (iso3c)")
def country_join_inner(spark, sf):
    return _joined(spark, sf, "inner")


@query(_SIDES + "SELECT iso3c, CAST(bal AS DOUBLE) AS bal, suppliers FROM x FULL JOIN y USING (iso3c)")
def country_join_full(spark, sf):
    return _joined(spark, sf, "full")


_NULLKEY = """, x AS (SELECT DISTINCT c_mktsegment AS seg, CASE WHEN c_nationkey % 2 = 0 THEN iso3c END AS iso3c FROM customer JOIN spine ON c_nationkey = n_nationkey),
y AS (SELECT CASE WHEN n_nationkey % 5 > 0 THEN iso3c END AS iso3c, n_nationkey AS k FROM spine) """


@query(_NULLKEY + "SELECT x.iso3c, seg, k FROM x LEFT JOIN y ON x.iso3c IS NOT DISTINCT FROM y.iso3c")
def country_join_nullkey(spark, sf):
    s = fx.spine(spark)
    x = fx.table(spark, sf, "customer").join(F.broadcast(s), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("seg"), F.when(F.col("c_nationkey") % 2 == 0, F.col("iso3c")).alias("iso3c")).distinct()
    y = s.select(F.when(F.col("n_nationkey") % 5 > 0, F.col("iso3c")).alias("iso3c"), F.col("n_nationkey").alias("k"))
    return joins.spine_join(x, y, "left").select("iso3c", "seg", "k")


@query(_SIDES + """, z AS (SELECT iso3c, sum(pop) AS pop FROM panel GROUP BY 1)
SELECT iso3c, CAST(bal AS DOUBLE) AS bal, suppliers, CAST(pop AS BIGINT) AS pop FROM x FULL JOIN y USING (iso3c) FULL JOIN z USING (iso3c)""")
def country_join_all(spark, sf):
    x, y = _sides(spark, sf)
    z = fx.panel(spark, sf).groupBy("iso3c").agg(F.sum("pop").alias("pop")).withColumnRenamed("iso3c", "c3")
    return joins.country_join_all([x, y, z], ["country", "code", "c3"], ["country.name", "iso2c", "iso3c"]).select("iso3c", F.col("bal").cast("double").alias("bal"), "suppliers", "pop")


@query('SELECT r.iso3c, "group", "order", long, lat, gdp FROM ring r LEFT JOIN (SELECT iso3c, gdp FROM panel WHERE year = 1996 AND iso3c < \'P\') p USING (iso3c)')
def attach_geometry(spark, sf):
    data = fx.panel(spark, sf).where("year = 1996 and iso3c < 'P'").select("iso3c", "gdp")
    return joins.attach_geometry(data, fx.ring(spark)).select("iso3c", "group", "order", "long", "lat", "gdp")


@query('SELECT r.iso3c, count(*) AS vertices, max(n) AS n FROM ring r LEFT JOIN (SELECT iso3c, count(*) AS n FROM people GROUP BY 1) USING (iso3c) GROUP BY 1')
def join_world(spark, sf):
    data = fx.people(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return joins.join_world(data, fx.ring(spark), add=()).groupBy("iso3c").agg(F.count(F.lit(1)).alias("vertices"), F.max("n").alias("n"))


# -- diagnostics --------------------------------------------------------------------

_TYPOS = [(0, "Germny"), (1, "Brzil"), (2, "Frnace"), (3, "Wakanda"), (4, "Kenia"), (5, "Marocco"), (6, "Peruu")]


@query(f""", typos(i, input) AS (VALUES {fx.values(_TYPOS)}),
near AS (SELECT input, arg_min(name, d) AS suggestion, min(d) AS dist FROM (SELECT input, trim(messy_name) AS name, 1 - jaro_similarity(input, trim(messy_name)) AS d FROM typos, spine) GROUP BY 1)
SELECT input, count(*) AS n, max(suggestion) AS suggestion, round(max(dist), 6) AS dist FROM customer JOIN typos ON c_custkey % 7 = i JOIN near USING (input) GROUP BY 1""")
def nearest_name(spark, sf):
    typos = spark.createDataFrame(_TYPOS, "i int, input string")
    df = fx.table(spark, sf, "customer").join(F.broadcast(typos), F.col("c_custkey") % 7 == F.col("i"))
    names = fx.spine(spark).select(F.col("n_nationkey").alias("ord"), F.trim("messy_name").alias("name"))
    near = diagnostics.nearest_names(df, names).select("input", "suggestion", r6("distance").alias("dist"))
    return df.groupBy("input").agg(F.count(F.lit(1)).alias("n")).join(near, "input")


@query(f""", names(i, input, iso3c, historical) AS (VALUES {fx.values([(0, "USSR", "RUS", "Soviet Union"), (1, "Yugoslavia", None, "Yugoslavia"), (2, "Wakanda", None, None), (3, "France", "FRA", None), (4, "Sudan", "SDN", None), (5, "former  Sudan", None, "Sudan (former)"), (6, "U.S.", "USA", None)])})
SELECT input, iso3c, iso3c IS NOT NULL AS matched, historical, count(*) AS n FROM customer JOIN names ON c_custkey % 7 = i GROUP BY ALL""")
def check_country_match(spark, sf):
    names = F.array(*map(F.lit, ["USSR", "Yugoslavia", "Wakanda", "France", "Sudan", "former  Sudan", "U.S."]))
    df = fx.table(spark, sf, "customer").select(F.element_at(names, (F.col("c_custkey") % 7 + 1).cast("int")).alias("name"))
    return diagnostics.check_country_match(df, "name", suggest=False).groupBy("input", "iso3c", "matched", "historical").agg(F.count(F.lit(1)).alias("n"))


@query(f""", fixed(i, repaired) AS (VALUES {fx.values([(0, "Germany"), (1, "Brazil"), (2, "France"), (3, "Wakanda"), (4, "Kenya"), (5, "Morocco"), (6, "Peru")])})
SELECT c_custkey, repaired AS name FROM customer JOIN fixed ON c_custkey % 7 = i""")
def repair_names(spark, sf):
    typos = spark.createDataFrame(_TYPOS, "i int, name string")
    df = fx.table(spark, sf, "customer").join(F.broadcast(typos), F.col("c_custkey") % 7 == F.col("i")).select("c_custkey", "name")
    return diagnostics.repair_country_names(df, "name")[0]


_OLD = ["ussr", "Yugoslavia", " Czecho-Slovakia", "France", "Wakanda", "GDR", "Zanzibar", "Former Sudan"]
# Dissolved entities, the year, and successors.
_SUCCESSORS = [
    ("Soviet Union", 1991, "ARM"),
    ("Soviet Union", 1991, "AZE"),
    ("Soviet Union", 1991, "BLR"),
    ("Soviet Union", 1991, "EST"),
    ("Soviet Union", 1991, "GEO"),
    ("Soviet Union", 1991, "KAZ"),
    ("Soviet Union", 1991, "KGZ"),
    ("Soviet Union", 1991, "LTU"),
    ("Soviet Union", 1991, "LVA"),
    ("Soviet Union", 1991, "MDA"),
    ("Soviet Union", 1991, "RUS"),
    ("Soviet Union", 1991, "TJK"),
    ("Soviet Union", 1991, "TKM"),
    ("Soviet Union", 1991, "UKR"),
    ("Soviet Union", 1991, "UZB"),
    ("Yugoslavia", 1992, "BIH"),
    ("Yugoslavia", 1992, "HRV"),
    ("Yugoslavia", 1992, "MKD"),
    ("Yugoslavia", 1992, "MNE"),
    ("Yugoslavia", 1992, "SRB"),
    ("Yugoslavia", 1992, "SVN"),
    ("Yugoslavia", 1992, "XKX"),
    ("Serbia and Montenegro", 2006, "MNE"),
    ("Serbia and Montenegro", 2006, "SRB"),
    ("Serbia and Montenegro", 2006, "XKX"),
    ("Czechoslovakia", 1993, "CZE"),
    ("Czechoslovakia", 1993, "SVK"),
    ("East Germany", 1990, "DEU"),
    ("Netherlands Antilles", 2010, "BES"),
    ("Netherlands Antilles", 2010, "CUW"),
    ("Netherlands Antilles", 2010, "SXM"),
    ("North Yemen", 1990, "YEM"),
    ("South Yemen", 1990, "YEM"),
    ("Sudan (former)", 2011, "SDN"),
    ("Sudan (former)", 2011, "SSD"),
    ("United Arab Republic", 1961, "EGY"),
    ("United Arab Republic", 1961, "SYR"),
    ("Tanganyika", 1964, "TZA"),
    ("Zanzibar", 1964, "TZA"),
    ("North Vietnam", 1976, "VNM"),
    ("South Vietnam", 1976, "VNM"),
]
_AFTER = f"SELECT * FROM (VALUES {fx.values(_SUCCESSORS)}) t(e, dissolved, code)"


@query(f""", old(i, input) AS (VALUES {fx.values(enumerate(_OLD))}), alias(input, e) AS (VALUES ('ussr', 'Soviet Union'), ('Yugoslavia', 'Yugoslavia'), (' Czecho-Slovakia', 'Czechoslovakia'), ('GDR', 'East Germany'), ('Zanzibar', 'Zanzibar'), ('Former Sudan', 'Sudan (former)')),
after AS ({_AFTER}), d AS (SELECT i, input, e FROM old LEFT JOIN alias USING (input))
SELECT c_custkey, input, e AS historical, dissolved, CASE WHEN e IS NOT NULL THEN code WHEN input = 'France' THEN 'FRA' END AS iso3c
FROM customer JOIN d ON c_custkey % {len(_OLD)} = i LEFT JOIN after USING (e)""")
def dissolve_country(spark, sf):
    names = F.array(*map(F.lit, _OLD))
    df = fx.table(spark, sf, "customer").select("c_custkey", F.element_at(names, (F.col("c_custkey") % len(_OLD) + 1).cast("int")).alias("name"))
    return df.join(diagnostics.dissolve_country(df.select("name").distinct(), "name"), F.col("name") == F.col("input")).select("c_custkey", "input", "historical", "dissolved", "iso3c")


@query("SELECT 'gdp' AS indicator, count(*) AS n, count(*) - count(gdp) AS n_missing, round((count(*) - count(gdp)) / count(*), 8) AS na_rate FROM holes")
def audit_na_rates(spark, sf):
    return aggregate.na_rates(fx.holes(spark, sf), ["gdp"]).withColumn("na_rate", r6("na_rate", 8))


@query("SELECT region, count(*) AS n_countries, round(avg(CASE WHEN gdp IS NULL THEN 1.0 ELSE 0.0 END), 8) AS na_rate FROM holes GROUP BY 1")
def audit_by_group(spark, sf):
    return aggregate.audit_coverage(fx.holes(spark, sf), ["gdp"]).by_group.withColumn("na_rate", r6("na_rate", 8))


@query("SELECT DISTINCT CASE WHEN c_nationkey % 6 = 0 THEN 'Nowhere ' || c_nationkey ELSE messy_name END AS country FROM customer JOIN spine ON c_nationkey = n_nationkey WHERE c_nationkey % 6 = 0")
def audit_unmatched(spark, sf):
    s = fx.spine(spark)
    df = fx.table(spark, sf, "customer").join(F.broadcast(s), F.col("c_nationkey") == F.col("n_nationkey")).select(F.when(F.col("c_nationkey") % 6 == 0, F.concat(F.lit("Nowhere "), F.col("c_nationkey"))).otherwise(F.col("messy_name")).alias("country"), "c_acctbal")
    return aggregate.audit_coverage(resolve.resolved(df, "country"), ["c_acctbal"]).unmatched


# -- aggregation ----------------------------------------------------------------------


def _regional(fun, sql):
    def run(spark, sf):
        return aggregate.aggregate_regions(fx.panel(spark, sf), "gdp", ["region", "year"], fun, weight="pop").withColumn("gdp", r6("gdp", 4))

    run.__name__ = f"aggregate_{fun}"
    query(f"SELECT region, year, round({sql}, 4) AS gdp FROM panel GROUP BY 1, 2")(run)


for _fun, _sql in {"sum": "CAST(sum(CAST(gdp AS DECIMAL(38,2))) AS DOUBLE)", "mean": "avg(gdp)", "median": "median(gdp)", "min": "min(gdp)", "max": "max(gdp)", "weighted_mean": "sum(gdp * pop) / sum(pop)"}.items():
    _regional(_fun, _sql)


@query("SELECT iso3c, arg_max(gdp, year) FILTER (WHERE gdp IS NOT NULL) AS gdp FROM holes GROUP BY 1")
def latest_value(spark, sf):
    return aggregate.latest_value(fx.holes(spark, sf), ["gdp"])


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def keep_first(spark, sf):
    return aggregate.keep_first(fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# -- panel ----------------------------------------------------------------------------

_LATEST = ", c AS (SELECT iso3c, region, gdp, pop FROM panel WHERE year = 2000) "


@query("""SELECT c_custkey, CAST(rank() OVER (ORDER BY c_acctbal DESC) AS INTEGER) AS rank, round((rank() OVER (ORDER BY c_acctbal) - 1.0) / (count(*) OVER () - 1), 8) AS percentile,
 round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z_score FROM customer""")
def rank_countries(spark, sf):
    out = panel.rank_countries(fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.select("c_custkey", "rank", r6("percentile", 8).alias("percentile"), r6("z_score").alias("z_score"))


@query("""SELECT iso3c, year, CASE WHEN gdp IS NOT NULL THEN CAST(rank() OVER (PARTITION BY region ORDER BY gdp NULLS LAST) AS INTEGER) END AS rank,
 round(CASE WHEN gdp IS NOT NULL THEN (rank() OVER (PARTITION BY region ORDER BY gdp NULLS LAST) - 1.0) / (count(gdp) OVER (PARTITION BY region) - 1) END, 8) AS percentile FROM holes""")
def rank_within_region(spark, sf):
    out = panel.rank_countries(fx.holes(spark, sf), "gdp", within="region", desc=False)
    return out.select("iso3c", "year", "rank", r6("percentile", 8).alias("percentile"))


@query("SELECT year, iso3c, rank FROM (SELECT year, iso3c, CAST(rank() OVER (PARTITION BY year ORDER BY gdp DESC) AS INTEGER) AS rank FROM panel) WHERE rank <= 5")
def topk(spark, sf):
    return panel.top_k(panel.rank_countries(fx.panel(spark, sf), "gdp", within="year"), 5).select("year", "iso3c", "rank")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (SELECT sum(l_quantity) FROM lineitem) * 1e6, 6) AS share FROM lineitem")
def share_of_world(spark, sf):
    out = panel.share_of_world(fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_quantity_share") * 1e6).alias("share"))


@query("SELECT iso3c, year, round(gdp / sum(gdp) OVER (PARTITION BY year), 8) AS gdp_share FROM holes")
def share_by_year(spark, sf):
    return panel.share_of_world(fx.holes(spark, sf), "gdp").select("iso3c", "year", r6("gdp_share", 8).alias("gdp_share"))


@query("SELECT iso3c, year, round(gdp / lag(gdp) OVER (PARTITION BY iso3c ORDER BY year) - 1, 8) AS gdp_growth FROM holes")
def growth_yoy(spark, sf):
    return panel.growth_rate(fx.holes(spark, sf), "gdp").select("iso3c", "year", r6("gdp_growth", 8).alias("gdp_growth"))


@query(""", f AS (SELECT iso3c, arg_min(gdp, year) AS v0, min(year) AS y0 FROM holes WHERE gdp IS NOT NULL GROUP BY 1)
SELECT iso3c, year, round(CASE WHEN year > y0 THEN pow(gdp / v0, 1.0 / (year - y0)) - 1 END, 8) AS gdp_growth FROM holes LEFT JOIN f USING (iso3c)""")
def growth_cagr(spark, sf):
    return panel.growth_rate(fx.holes(spark, sf), "gdp", "cagr").select("iso3c", "year", r6("gdp_growth", 8).alias("gdp_growth"))


@query("SELECT iso3c, year, round(gdp / nullif(max(CASE WHEN year = 1998 THEN gdp END) OVER (PARTITION BY iso3c), 0) * 100, 6) AS gdp_index FROM holes")
def index_to(spark, sf):
    return panel.index_to(fx.holes(spark, sf), "gdp", 1998).select("iso3c", "year", r6("gdp_index").alias("gdp_index"))


@query("SELECT iso3c, year, lag(gdp, 2) OVER (PARTITION BY iso3c ORDER BY year) AS gdp_lag2 FROM holes")
def lag_n(spark, sf):
    return panel.lag_by_country(fx.holes(spark, sf), "gdp", 2).select("iso3c", "year", "gdp_lag2")


@query("SELECT a.iso3c, a.year, b.gdp AS gdp_lag FROM holes a LEFT JOIN holes b ON a.iso3c = b.iso3c AND b.year = a.year - 1")
def lag_years(spark, sf):
    return panel.lag_by_country(fx.holes(spark, sf), "gdp", by="year").select("iso3c", "year", "gdp_lag")


@query("SELECT iso3c, year, round(gdp - lag(gdp) OVER (PARTITION BY iso3c ORDER BY year), 4) AS gdp_diff FROM holes")
def diff_n(spark, sf):
    return panel.diff_by_country(fx.holes(spark, sf), "gdp").select("iso3c", "year", r6("gdp_diff", 4).alias("gdp_diff"))


_GRID = """, g AS (SELECT iso3c, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT iso3c FROM holes), (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM holes)),
f AS (SELECT g.iso3c, g.year, h.gdp, max(h.region) OVER (PARTITION BY g.iso3c) AS region FROM g LEFT JOIN holes h USING (iso3c, year)) """


@query(_GRID + "SELECT iso3c, year, region, gdp FROM f")
def complete_none(spark, sf):
    return panel.complete_years(fx.holes(spark, sf)).select("iso3c", "year", "region", "gdp")


@query(_GRID + "SELECT iso3c, year, region, last_value(gdp IGNORE NULLS) OVER (PARTITION BY iso3c ORDER BY year) AS gdp FROM f")
def complete_locf(spark, sf):
    return panel.complete_years(fx.holes(spark, sf), method="locf").select("iso3c", "year", "region", "gdp")


@query(_GRID + """, p AS (SELECT *, last_value(CASE WHEN gdp IS NOT NULL THEN year END IGNORE NULLS) OVER w AS ya, last_value(gdp IGNORE NULLS) OVER w AS va,
  first_value(CASE WHEN gdp IS NOT NULL THEN year END IGNORE NULLS) OVER u AS yb, first_value(gdp IGNORE NULLS) OVER u AS vb FROM f
  WINDOW w AS (PARTITION BY iso3c ORDER BY year), u AS (PARTITION BY iso3c ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT iso3c, year, region, round(coalesce(gdp, va + (vb - va) * (year - ya) / (yb - ya)), 4) AS gdp FROM p""")
def complete_linear(spark, sf):
    return panel.complete_years(fx.holes(spark, sf), method="linear").select("iso3c", "year", "region", r6("gdp", 4).alias("gdp"))


@query("SELECT iso3c, year, round(gdp / pop, 6) AS gdp_per_capita FROM panel")
def per_capita(spark, sf):
    return panel.per_capita(fx.panel(spark, sf), "gdp", "pop").select("iso3c", "year", r6("gdp_per_capita").alias("gdp_per_capita"))


@query("SELECT h.iso3c, h.year, round(h.gdp / pop, 6) AS gdp_per_capita FROM holes h LEFT JOIN panel p USING (iso3c, year)")
def per_capita_joined(spark, sf):
    population = fx.panel(spark, sf).select("iso3c", "year", F.col("pop").alias("population"))
    return panel.per_capita(fx.holes(spark, sf), "gdp", population=population).select("iso3c", "year", r6("gdp_per_capita").alias("gdp_per_capita"))


def _not_numbers(spark, sf):
    """holes with NaN in place of null."""
    return fx.holes(spark, sf).withColumn("gdp", F.coalesce("gdp", F.lit(float("nan"))))


@query("""SELECT iso3c, year, CASE WHEN gdp IS NOT NULL THEN CAST(rank() OVER (PARTITION BY year ORDER BY gdp DESC NULLS LAST) AS INTEGER) END AS rank,
  round((gdp - avg(gdp) OVER (PARTITION BY year)) / stddev_samp(gdp) OVER (PARTITION BY year), 6) AS z_score, round(gdp / sum(gdp) OVER (PARTITION BY year), 8) AS gdp_share,
  round(gdp / lag(gdp) OVER (PARTITION BY iso3c ORDER BY year) - 1, 8) AS gdp_growth, round(gdp / max(CASE WHEN year = 1998 THEN gdp END) OVER (PARTITION BY iso3c) * 100, 6) AS gdp_index FROM holes""")
def nan_panel(spark, sf):
    out = panel.index_to(panel.growth_rate(panel.share_of_world(panel.rank_countries(_not_numbers(spark, sf), "gdp", "year"), "gdp"), "gdp"), "gdp", 1998)
    return out.select("iso3c", "year", "rank", r6("z_score").alias("z_score"), r6("gdp_share", 8).alias("gdp_share"), r6("gdp_growth", 8).alias("gdp_growth"), r6("gdp_index").alias("gdp_index"))


@query(_GRID + "SELECT iso3c, year, region, last_value(gdp IGNORE NULLS) OVER (PARTITION BY iso3c ORDER BY year) AS gdp FROM f")
def nan_complete(spark, sf):
    return panel.complete_years(_not_numbers(spark, sf), method="locf").select("iso3c", "year", "region", "gdp")


@query("""SELECT 'mean' AS what, round(avg(gdp), 4) AS v FROM holes UNION ALL SELECT 'median', round(median(gdp), 4) FROM holes UNION ALL SELECT 'max', max(gdp) FROM holes UNION ALL SELECT 'sum', round(sum(gdp), 2) FROM holes UNION ALL
SELECT 'theil', round(sum(gdp / m * ln(gdp / m)) / count(gdp), 8) FROM holes, (SELECT avg(gdp) AS m FROM holes) UNION ALL SELECT 'sigma ' || year, round(stddev_samp(ln(gdp)), 8) FROM holes WHERE gdp IS NOT NULL GROUP BY year""")
def nan_aggregates(spark, sf):
    df = _not_numbers(spark, sf).withColumn("world", F.lit(1))
    digits = {"mean": 4, "median": 4, "max": 4, "sum": 2}
    out = aggregate.theil(df, "gdp").select(F.lit("theil").alias("what"), r6("theil", 8).alias("v"))
    for fun, n in digits.items():
        out = out.unionByName(aggregate.aggregate_regions(df, "gdp", "world", fun).select(F.lit(fun).alias("what"), r6("gdp", n).alias("v")))
    return out.unionByName(stats.sigma_convergence(df, "gdp").select(F.concat(F.lit("sigma "), "year").alias("what"), r6("sigma", 8).alias("v")))


# -- inequality, convergence, correlation -----------------------------------------------


@query("SELECT round(sum((2.0 * i - n - 1) * x) / (any_value(n) * sum(x)), 8) AS gini FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem)")
def gini(spark, sf):
    return aggregate.gini(fx.table(spark, sf, "lineitem"), "l_extendedprice").select(r6("gini", 8).alias("gini"))


@query(_LATEST + "SELECT round(sum(a.pop * b.pop * abs(a.gdp - b.gdp)) / (2.0 * any_value(w) * any_value(s)), 8) AS gini FROM c a, c b, (SELECT sum(pop) AS w, sum(pop * gdp) AS s FROM c)")
def gini_weighted(spark, sf):
    return aggregate.gini(fx.panel(spark, sf).where("year = 2000"), "gdp", "pop").select(r6("gini", 8).alias("gini"))


@query("SELECT round(sum(x / m * ln(x / m)) / count(*), 8) AS theil FROM (SELECT c_acctbal AS x, avg(c_acctbal) OVER () AS m FROM customer WHERE c_acctbal > 0)")
def theil(spark, sf):
    return aggregate.theil(fx.table(spark, sf, "customer"), "c_acctbal").select(r6("theil", 8).alias("theil"))


@query(""", c AS (SELECT c_acctbal AS x, c_mktsegment AS g FROM customer WHERE c_acctbal > 0), t AS (SELECT sum(x) AS s, avg(x) AS m FROM c),
p AS (SELECT sum(x / s * ln(x / m)) AS total FROM c, t), b AS (SELECT sum(sx / s * ln(mx / m)) AS between_ FROM (SELECT g, sum(x) AS sx, avg(x) AS mx FROM c GROUP BY g), t)
SELECT component, round(v, 8) AS value, round(v / total, 6) AS share FROM p, b, LATERAL (VALUES ('total', total), ('between', between_), ('within', total - between_)) q(component, v)""")
def theil_groups(spark, sf):
    return aggregate.theil(fx.table(spark, sf, "customer"), "c_acctbal", groups="c_mktsegment").select("component", r6("value", 8).alias("value"), r6("share").alias("share"))


@query("SELECT year, count(*) AS n, round(stddev_samp(ln(gdp)), 8) AS sigma FROM holes WHERE gdp > 0 GROUP BY 1")
def sigma_sd_log(spark, sf):
    return stats.sigma_convergence(fx.holes(spark, sf), "gdp").withColumn("sigma", r6("sigma", 8))


@query("SELECT year, count(*) AS n, round(stddev_samp(gdp) / avg(gdp), 8) AS sigma FROM holes WHERE gdp > 0 GROUP BY 1")
def sigma_cv(spark, sf):
    return stats.sigma_convergence(fx.holes(spark, sf), "gdp", "cv").withColumn("sigma", r6("sigma", 8))


@query(""", e AS (SELECT iso3c, arg_min(gdp, year) AS v0, arg_max(gdp, year) AS v1, max(year) - min(year) AS s FROM panel WHERE gdp > 0 GROUP BY 1 HAVING max(year) > min(year)),
t AS (SELECT (ln(v1) - ln(v0)) / s AS g, ln(v0) AS x FROM e)
SELECT round(regr_slope(g, x), 8) AS beta, round(regr_r2(g, x), 8) AS r_squared, count(*) AS n FROM t""")
def beta_convergence(spark, sf):
    return stats.beta_convergence(fx.panel(spark, sf), "gdp").select(r6("beta", 8).alias("beta"), r6("r_squared", 8).alias("r_squared"), "n")


@query("""SELECT * FROM (
SELECT 'l_quantity' AS var_x, 'l_extendedprice' AS var_y, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem UNION ALL
SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6), count(*) FROM lineitem UNION ALL
SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6), count(*) FROM lineitem)""")
def correlate_pearson(spark, sf):
    return stats.correlate_indicators(fx.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", r6("r"))


@query("""SELECT 'gdp' AS var_x, 'pop' AS var_y, round(corr(a, b), 6) AS r, count(*) AS n FROM (
SELECT rank() OVER (ORDER BY gdp) + (count(*) OVER (PARTITION BY gdp) - 1) / 2.0 AS a, rank() OVER (ORDER BY pop) + (count(*) OVER (PARTITION BY pop) - 1) / 2.0 AS b FROM panel)""")
def correlate_spearman(spark, sf):
    return stats.correlate_indicators(fx.panel(spark, sf), ["gdp", "pop"], "spearman").withColumn("r", r6("r"))


@query(_LATEST + """, sym AS (SELECT iso3c_a AS a, iso3c_b AS b FROM edges UNION SELECT iso3c_b, iso3c_a FROM edges), k AS (SELECT a, b FROM sym WHERE a IN (SELECT iso3c FROM c) AND b IN (SELECT iso3c FROM c)),
z AS (SELECT iso3c, gdp - avg(gdp) OVER () AS z FROM c WHERE iso3c IN (SELECT a FROM k)), m AS (SELECT a, avg(z) AS zn FROM k JOIN z ON b = iso3c GROUP BY a)
SELECT round(sum(z * zn) / sum(z * z), 8) AS morans_i, round(-1.0 / (count(*) - 1), 8) AS expected, count(*) AS n, (SELECT count(*) // 2 FROM k) AS n_links FROM z JOIN m ON a = iso3c""")
def morans_i(spark, sf):
    edges = spatial.country_borders(fx.ring(spark))
    out = stats.morans_i(fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp"), "gdp", edges, n_perm=0)
    return out.select(r6("morans_i", 8).alias("morans_i"), r6("expected", 8).alias("expected"), "n", "n_links")


# -- space --------------------------------------------------------------------------------

_HAVERSINE = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b1} - {b0}) / 2), 2) + cos(radians({b0})) * cos(radians({b1})) * pow(sin(radians({a1} - {a0}) / 2), 2))))"


@query("SELECT c_custkey, round(" + _HAVERSINE.format(a0="lon", b0="lat", a1="CAST(c_custkey % 360 - 180 AS DOUBLE)", b1="CAST(c_custkey % 170 - 85 AS DOUBLE)") + ", 6) AS km FROM people JOIN geo USING (iso3c)")
def haversine(spark, sf):
    df = resolve.resolved(fx.people(spark, sf), "country").join(F.broadcast(fx.geo(spark)), "iso3c")
    km = haversine_km(F.col("lon"), F.col("lat"), (F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 170 - 85).cast("double"))
    return df.select("c_custkey", r6(km).alias("km"))


_POINTS = "SELECT c_custkey, CAST((c_custkey * 7 % 701) / 10.0 - 30.03 AS DOUBLE) AS lon, CAST((c_custkey * 11 % 691) / 10.0 - 29.07 AS DOUBLE) AS lat FROM customer"


def _points(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select("c_custkey", ((k * 7 % 701) / 10.0 - 30.03).alias("lon"), ((k * 11 % 691) / 10.0 - 29.07).alias("lat"))


_BOXES = ", p AS (" + _POINTS + '), box AS (SELECT iso3c, "group" AS g, min(long) AS x0, max(long) AS x1, min(lat) AS y0, max(lat) AS y1 FROM ring GROUP BY 1, 2) '


@query(_BOXES + "SELECT c_custkey, iso3c FROM p LEFT JOIN box ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def locate_country(spark, sf):
    return spatial.locate_country(_points(spark, sf), fx.ring(spark), tolerance_km=0).select("c_custkey", "iso3c")


@query(_BOXES + """, near AS (SELECT c_custkey, iso3c, g, """ + _HAVERSINE.format(a0="lon", b0="lat", a1="greatest(x0, least(x1, lon))", b1="greatest(y0, least(y1, lat))") + """ AS km FROM p, box)
SELECT p.c_custkey, b.iso3c FROM p LEFT JOIN (SELECT c_custkey, arg_min(iso3c, (km, g)) AS iso3c FROM near WHERE km <= 60 GROUP BY 1) b USING (c_custkey)""")
def locate_snap(spark, sf):
    return spatial.locate_country(_points(spark, sf), fx.ring(spark), tolerance_km=60).select("c_custkey", "iso3c")


# -- map preparation --------------------------------------------------------------------


@query(_LATEST + ", b AS (SELECT quantile_cont(gdp, [0.25, 0.5, 0.75]) AS q FROM c) SELECT iso3c, CAST(1 + (gdp > q[1])::INT + (gdp > q[2])::INT + (gdp > q[3])::INT AS INTEGER) AS bin FROM c, b")
def quantile_bins(spark, sf):
    c = fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp")
    return viz_prep.world_map(c, "gdp", "quantile", 4).select("iso3c", "bin")


@query(_LATEST + """, b AS (SELECT quantile_cont(gdp, [1/3, 2/3]) AS x, quantile_cont(pop, [1/3, 2/3]) AS y FROM c)
SELECT iso3c, (1 + (gdp > x[1])::INT + (gdp > x[2])::INT) || '-' || (1 + (pop > y[1])::INT + (pop > y[2])::INT) AS class FROM c, b""")
def bivariate_classes(spark, sf):
    c = fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp", "pop")
    return viz_prep.bivariate_classes(c, "gdp", "pop").select("iso3c", "class")


@query(_LATEST + """SELECT iso3c, ord, round(lon + dx, 6) AS x, round(lat + up * gdp / (SELECT max(gdp) FROM c) * 20, 6) AS y FROM c JOIN geo USING (iso3c), (VALUES (1, -0.8, 0), (2, 0.0, 1), (3, 0.8, 0)) k(ord, dx, up)""")
def spike_triangles(spark, sf):
    c = fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp")
    return viz_prep.spike_triangles(c, "gdp", fx.geo(spark)).select("iso3c", "ord", r6("x").alias("x"), r6("y").alias("y"))


_ARC = """, f AS (SELECT DISTINCT cs.iso3c AS a, ss.iso3c AS b FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT DISTINCT s_nationkey FROM supplier), spine cs, spine ss
  WHERE cs.n_nationkey = c_nationkey AND ss.n_nationkey = s_nationkey AND (c_nationkey + s_nationkey) % 5 = 0),
g AS (SELECT a, b, radians(ga.lon) AS l1, radians(ga.lat) AS p1, radians(gb.lon) AS l2, radians(gb.lat) AS p2 FROM f JOIN geo ga ON ga.iso3c = a JOIN geo gb ON gb.iso3c = b),
d AS (SELECT *, 2 * asin(least(1.0, sqrt(pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin((l2 - l1) / 2), 2)))) AS d FROM g),
s AS (SELECT *, unnest(range(10)) AS i FROM d), w AS (SELECT *, CASE WHEN d = 0 THEN 1 ELSE sin((1 - i / 9.0) * d) / sin(d) END AS u, CASE WHEN d = 0 THEN 0 ELSE sin(i / 9.0 * d) / sin(d) END AS v FROM s),
x AS (SELECT *, u * cos(p1) * cos(l1) + v * cos(p2) * cos(l2) AS x, u * cos(p1) * sin(l1) + v * cos(p2) * sin(l2) AS y, u * sin(p1) + v * sin(p2) AS z FROM w)
SELECT a AS iso3c_from, b AS iso3c_to, CAST(i + 1 AS INTEGER) AS ord, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat FROM x"""


@query(_ARC)
def flow_arcs(spark, sf):
    s = fx.spine(spark)
    a = fx.table(spark, sf, "customer").select("c_nationkey").distinct()
    b = fx.table(spark, sf, "supplier").select("s_nationkey").distinct()
    pairs = a.crossJoin(F.broadcast(b)).where("(c_nationkey + s_nationkey) % 5 = 0")
    pairs = pairs.join(F.broadcast(s.select(F.col("n_nationkey").alias("c_nationkey"), F.col("messy_name").alias("origin"))), "c_nationkey").join(F.broadcast(s.select(F.col("n_nationkey").alias("s_nationkey"), F.col("iso3c").alias("to3"), F.col("messy_name").alias("target"))), "s_nationkey")
    out = viz_prep.flow_arcs(pairs, "origin", "target", fx.geo(spark), n=10)
    return out.select("iso3c_from", "iso3c_to", "ord", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query("SELECT iso3c, n_nationkey // 5 + 1 AS row, n_nationkey % 5 + 1 AS col, gdp FROM spine LEFT JOIN (SELECT iso3c, gdp FROM panel WHERE year = 2000 AND region <> 'ASIA') p USING (iso3c)")
def tile_join(spark, sf):
    tiles = fx.spine(spark).select("iso3c", F.expr("cast(n_nationkey div 5 + 1 as int)").alias("row"), (F.col("n_nationkey") % 5 + 1).alias("col"))
    data = fx.panel(spark, sf).where("year = 2000 and region <> 'ASIA'").select("iso3c", "gdp")
    return viz_prep.tile_map(data, tiles)


# -- sources and sinks --------------------------------------------------------------------


@query("SELECT iso3c, year, h.gdp AS gdp, CAST(p.pop AS DOUBLE) AS pop FROM holes h FULL JOIN (SELECT iso3c, year, pop FROM panel WHERE year <> 1999) p USING (iso3c, year)")
def indicator_merge(spark, sf):
    none = F.lit(None).cast("string")
    long = fx.holes(spark, sf).select(F.lit("G").alias("code"), "iso3c", none.alias("iso2c"), none.alias("country"), "year", F.col("gdp").alias("value"))
    more = fx.panel(spark, sf).where("year <> 1999").select(F.lit("P").alias("code"), "iso3c", none.alias("iso2c"), none.alias("country"), "year", F.col("pop").cast("double").alias("value"))
    return ind.merge_indicators(long.unionByName(more), {"gdp": "G", "pop": "P"}).select("iso3c", "year", "gdp", "pop")


@query("SELECT iso3c_year AS key, n FROM (SELECT iso3c || year AS iso3c_year, count(*) AS n FROM ring JOIN panel USING (iso3c) GROUP BY 1)")
def facet_frames(spark, sf):
    years = viz_prep.frame_values(fx.panel(spark, sf))
    df = joins.spine_join(fx.ring(spark), fx.panel(spark, sf), "inner").where(F.col("year").isin(years))
    return df.groupBy(F.concat("iso3c", F.col("year").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(_LATEST + "SELECT c.iso3c, gdp, lon, lat FROM c LEFT JOIN (SELECT * FROM geo WHERE iso3c < 'M') g USING (iso3c)")
def bubble_points(spark, sf):
    c = fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp")
    return viz_prep.bubble_points(c, "gdp", fx.geo(spark).where("iso3c < 'M'"))


@query(_LATEST + ", b AS (SELECT min(gdp) AS lo, max(gdp) AS hi FROM c) SELECT iso3c, CAST(greatest(1, ceil(round((gdp - lo) / (hi - lo) * 4, 9))) AS INTEGER) AS bin FROM c, b")
def equal_bins(spark, sf):
    c = fx.panel(spark, sf).where("year = 2000").select("iso3c", "gdp")
    return viz_prep.world_map(c, "gdp", "equal", 4).select("iso3c", "bin")


@query(_LATEST + ", p AS (SELECT iso3c, gdp, region FROM c) SELECT region, count(*) AS n, round(sum(gdp) / (SELECT sum(gdp) FROM c), 8) AS share FROM p GROUP BY 1")
def regional_share(spark, sf):
    c = panel.share_of_world(fx.panel(spark, sf).where("year = 2000").drop("year"), "gdp")
    return c.groupBy("region").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("gdp_share"), 8).alias("share"))


@query(_GRID + "SELECT iso3c, year, region, gdp FROM f WHERE year BETWEEN 1997 AND 1999 UNION ALL SELECT iso3c, year, region, gdp FROM holes WHERE year NOT BETWEEN 1997 AND 1999")
def complete_given_years(spark, sf):
    return panel.complete_years(fx.holes(spark, sf), [1997, 1998, 1999]).select("iso3c", "year", "region", "gdp")


@query("""SELECT iso3c, "group", "order", round(cx + (long - cx) * s, 6) AS long, round(cy + (lat - cy) * s, 6) AS lat FROM ring
JOIN (SELECT iso3c, cx, cy, sqrt(n / a / max(n / a) OVER ()) AS s FROM (SELECT iso3c, (min(long) + max(long)) / 2 AS cx, (min(lat) + max(lat)) / 2 AS cy, 6371.0088 * 6371.0088 / 2 * abs(radians(10) * (2 + 2 * sin(radians(min(lat)))) - radians(10) * (2 + 2 * sin(radians(max(lat))))) AS a FROM ring GROUP BY 1)
JOIN (SELECT iso3c, count(*) AS n FROM people GROUP BY 1) USING (iso3c)) USING (iso3c)""")
def cartogram(spark, sf):
    df = resolve.resolved(fx.people(spark, sf), "country").groupBy("iso3c").agg(F.count(F.lit(1)).alias("n"))
    return viz_prep.cartogram_scale(df, "n", fx.ring(spark)).select("iso3c", "group", "order", r6("long").alias("long"), r6("lat").alias("lat"))
