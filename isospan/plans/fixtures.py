"""Inputs derived from the driver's tables, each with the same definition in SQL.

The tables hold no country names, so nation keys are given real codes and messy
spellings; panels, coordinates and rings follow from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# nation key, alpha-3, alpha-2, continent, messy spelling
SPINE = [
    (0, "DZA", "DZ", "Africa", "Algeria"),
    (1, "ARG", "AR", "Americas", "argentina"),
    (2, "BRA", "BR", "Americas", " Brazil "),
    (3, "CAN", "CA", "Americas", "CANADA"),
    (4, "EGY", "EG", "Africa", "Egypt, Arab Rep."),
    (5, "ETH", "ET", "Africa", "Ethiopia"),
    (6, "FRA", "FR", "Europe", "France"),
    (7, "DEU", "DE", "Europe", "Germany"),
    (8, "IND", "IN", "Asia", "India"),
    (9, "IDN", "ID", "Asia", "Indonesia"),
    (10, "IRN", "IR", "Asia", "Iran, Islamic Rep."),
    (11, "IRQ", "IQ", "Asia", "Iraq"),
    (12, "JPN", "JP", "Asia", "Japan"),
    (13, "JOR", "JO", "Asia", "Jordan"),
    (14, "KEN", "KE", "Africa", "Kenya"),
    (15, "MAR", "MA", "Africa", "Morocco"),
    (16, "MOZ", "MZ", "Africa", "Mozambique"),
    (17, "PER", "PE", "Americas", "Peru"),
    (18, "CHN", "CN", "Asia", "People's Republic of China"),
    (19, "ROU", "RO", "Europe", "Romania"),
    (20, "SAU", "SA", "Asia", "Saudi Arabia"),
    (21, "VNM", "VN", "Asia", "Viet Nam"),
    (22, "RUS", "RU", "Europe", "Russian Federation"),
    (23, "GBR", "GB", "Europe", "U.K."),
    (24, "USA", "US", "Americas", "U.S."),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spine(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPINE, "n_nationkey int, iso3c string, iso2c string, continent string, messy_name string")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iso3c, year, region, gdp, pop) by customers' nation and order year."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(spine(spark)), "n_nationkey")
    place = place.select("n_nationkey", "iso3c", F.col("r_name").alias("region"))
    who = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "iso3c", "region")
    # one row per customer and year first: the distinct count is then a plain count
    per = t("orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")).groupBy("o_custkey", "year").agg(F.sum("price").alias("price"))
    got = per.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("iso3c", "year", "region").agg(F.sum("price").cast("double").alias("gdp"), F.count(F.lit(1)).alias("pop"))
    return got.select("iso3c", "year", "region", "gdp", "pop")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel (iso3c, year, region, gdp) without every fourth row and with every
    fifth gdp unknown."""
    k = F.ascii("iso3c") + F.ascii(F.substring("iso3c", 2, 1)) + F.col("year")
    return panel(spark, sf_dir).where(k % 4 != 0).select("iso3c", "year", "region", F.when(k % 5 != 0, F.col("gdp")).alias("gdp"))


def geo(spark: SparkSession) -> DataFrame:
    k = F.col("n_nationkey")
    return spine(spark).select("iso3c", ((k * 37) % 340 - 169.5).cast("double").alias("lon"), ((k * 23) % 140 - 69.75).cast("double").alias("lat"))


def ring(spark: SparkSession) -> DataFrame:
    from ..sources.geometry import square_grid

    return square_grid(spark, [r[1] for r in SPINE])


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, iso3c, continent, lon, lat): a place for every customer."""
    k = F.col("c_custkey")
    at = lambda m, n, less: F.round((k * m % n) / 10.0 - less, 2)
    who = table(spark, sf_dir, "customer").join(F.broadcast(spine(spark)), F.col("c_nationkey") == F.col("n_nationkey"))
    return who.select("c_custkey", "iso3c", "continent", at(7, 3401, 170).alias("lon"), at(11, 1391, 69.5).alias("lat"))


def _squares(spots: DataFrame, x, y, w) -> DataFrame:
    corners = F.array(*[F.struct(F.lit(k).alias("order"), (x + w * dx).alias("long"), (y + w * dy).alias("lat")) for k, dx, dy in ((1, -1, -1), (2, 1, -1), (3, 1, 1), (4, -1, 1))])
    return spots.select("iso3c", F.col("c_custkey").cast("int").alias("group"), F.explode(corners).alias("p")).select("iso3c", "group", "p.order", "p.long", "p.lat")


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square around every customer's place, of a size by key."""
    return _squares(spots(spark, sf_dir), F.col("lon"), F.col("lat"), 0.1 + (F.col("c_custkey") % 97) / 500.0)


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's square in a mesh of 40 columns, neighbours sharing vertices."""
    k = F.col("c_custkey")
    return _squares(spots(spark, sf_dir), (k % 40 * 2).cast("double"), F.expr("cast(c_custkey div 40 * 2 as double)"), F.lit(1.0))


def spread(spark: SparkSession, sf_dir: str, rows: list, schema: str) -> DataFrame:
    """(c_custkey, ...): every customer with one of the rows, by key."""
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return table(spark, sf_dir, "customer").select("c_custkey").join(F.broadcast(given), F.col("c_custkey") % len(rows) == F.col("_i")).drop("_i")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, country, iso, balance): every customer with its nation's messy name."""
    s = spine(spark)
    return table(spark, sf_dir, "customer").join(F.broadcast(s), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("messy_name").alias("country"), F.col("iso2c").alias("iso"), F.col("c_acctbal").alias("balance"))


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


CTE = f"""WITH spine(n_nationkey, iso3c, iso2c, continent, messy_name) AS (VALUES {_values(SPINE)}),
panel AS (
  SELECT s.iso3c, CAST(year(o_orderdate) AS INTEGER) AS year, r_name AS region,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp, count(DISTINCT o_custkey) AS pop
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN spine s USING (n_nationkey)
  GROUP BY 1, 2, 3),
holes AS (
  SELECT iso3c, year, region, CASE WHEN (ascii(iso3c) + ascii(substr(iso3c, 2, 1)) + year) % 5 <> 0 THEN gdp END AS gdp
  FROM panel WHERE (ascii(iso3c) + ascii(substr(iso3c, 2, 1)) + year) % 4 <> 0),
geo AS (SELECT iso3c, CAST((n_nationkey * 37) % 340 - 169.5 AS DOUBLE) AS lon, CAST((n_nationkey * 23) % 140 - 69.75 AS DOUBLE) AS lat FROM spine),
ring AS (
  SELECT CAST((n_nationkey % 5) * 10 - 20 + dx * 10 AS DOUBLE) AS long, CAST((n_nationkey // 5) * 10 - 20 + dy * 10 AS DOUBLE) AS lat,
         n_nationkey + 1 AS "group", k AS "order", iso3c
  FROM spine, (VALUES (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1)) c(k, dx, dy)),
edges AS (
  SELECT DISTINCT a.iso3c AS iso3c_a, b.iso3c AS iso3c_b FROM ring a JOIN ring b ON a.long = b.long AND a.lat = b.lat AND a.iso3c < b.iso3c),
spots AS (SELECT c_custkey, iso3c, continent, round((c_custkey * 7 % 3401)::DOUBLE / 10 - 170, 2) AS lon, round((c_custkey * 11 % 1391)::DOUBLE / 10 - 69.5, 2) AS lat FROM customer JOIN spine ON c_nationkey = n_nationkey),
corners(k, dx, dy) AS (VALUES (1, -1, -1), (2, 1, -1), (3, 1, 1), (4, -1, 1)),
lots AS (SELECT iso3c, CAST(c_custkey AS INTEGER) AS "group", k AS "order", lon + dx * (0.1 + (c_custkey % 97)::DOUBLE / 500) AS long, lat + dy * (0.1 + (c_custkey % 97)::DOUBLE / 500) AS lat FROM spots, corners),
mesh AS (SELECT iso3c, CAST(c_custkey AS INTEGER) AS "group", k AS "order", CAST(c_custkey % 40 * 2 + dx AS DOUBLE) AS long, CAST(c_custkey // 40 * 2 + dy AS DOUBLE) AS lat FROM spots, corners),
shared AS (SELECT DISTINCT a.iso3c AS iso3c_a, b.iso3c AS iso3c_b FROM (SELECT DISTINCT iso3c, long, lat FROM mesh) a JOIN (SELECT DISTINCT iso3c, long, lat FROM mesh) b ON a.long = b.long AND a.lat = b.lat AND a.iso3c < b.iso3c),
people AS (SELECT c_custkey, messy_name AS country, iso2c AS iso, iso3c, c_acctbal AS balance FROM customer JOIN spine ON c_nationkey = n_nationkey)
"""
values = _values


def spread_sql(rows: list, names: str, select: str = "*") -> str:
    """spread in SQL: rows as columns `names` beside c_custkey."""
    return f"SELECT {select if select == '*' else 'c_custkey, ' + select} FROM (SELECT c_custkey, t.* EXCLUDE (_i) FROM customer JOIN (VALUES {_values([(i, *r) for i, r in enumerate(rows)])}) t(_i, {names}) ON c_custkey % {len(rows)} = _i)"
