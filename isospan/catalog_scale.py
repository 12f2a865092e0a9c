"""Registered queries of operators that cut their work by size, or stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import query, r6
from .functions.text import jaro_similarity
from .operators import quantiles, resolve, viz_prep
from .plans import fixtures as fx
from .shared import new_folder
from .streaming.panel import panel_stream

# Names and the codes they stand for.
TOKEN_NAMES = [
    ("Macedonia (FYROM)", "MKD"), ("Hong Kong, China", "HKG"), ("Falkland Islands (Malvinas)", "FLK"), ("Libyan Arab Jamahiriya", "LBY"), ("Congo DR", "COD"), ("Cent. Afr. Rep.", "CAF"), ("The Former Yugoslav Republic of Macedonia", "MKD"),
    ("Trinidad & Tob.", "TTO"), ("Paris, France", "FRA"), ("Brazilian", "BRA"), ("Serbia and Kosovo", None), ("Netherlands Antilles", None), ("North Vietnam", None), ("Wakanda", None), ("a long sentence about the roads of France in spring", None),
]


@query(f"SELECT c_custkey, name, iso3c FROM customer JOIN (VALUES {fx.values([(i, *r) for i, r in enumerate(TOKEN_NAMES)])}) t(i, name, iso3c) ON c_custkey % {len(TOKEN_NAMES)} = i")
def resolve_by_tokens(spark, sf):
    names = F.array(*[F.lit(n) for n, _ in TOKEN_NAMES])
    df = fx.table(spark, sf, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % len(TOKEN_NAMES)).cast("int")).alias("name"))
    known = resolve.resolved(df.select("name").distinct(), "name", tokens=True)
    return df.join(F.broadcast(known), "name").select("c_custkey", "name", "iso3c")


@query("SELECT o_orderkey, round(jaro_similarity(o_orderpriority || o_orderkey, o_orderstatus || o_custkey || o_orderpriority), 8) AS jaro FROM orders")
def jaro_of_orders(spark, sf):
    o = fx.table(spark, sf, "orders")
    text = lambda *c: F.concat(*[F.col(x).cast("string") for x in c])
    return o.select("o_orderkey", r6(jaro_similarity(text("o_orderpriority", "o_orderkey"), text("o_orderstatus", "o_custkey", "o_orderpriority")), 8).alias("jaro"))


_PROBS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


@query(f"""SELECT flag, p AS prob, round(q, 6) AS quantile FROM (SELECT CASE WHEN l_returnflag < 'R' THEN 'most' ELSE l_returnflag END AS flag, unnest({list(_PROBS)}::DOUBLE[]) AS p, unnest(quantile_cont(l_extendedprice::DOUBLE, {list(_PROBS)})) AS q FROM lineitem GROUP BY 1)""")
def quantiles_by_group(spark, sf):
    """Brackets of 2,000 values at most, so that every group is narrowed down to."""
    flag = F.when(F.col("l_returnflag") < "R", "most").otherwise(F.col("l_returnflag"))
    df = fx.table(spark, sf, "lineitem").select(flag.alias("flag"), "l_extendedprice")
    return quantiles.exact_quantiles(df, "l_extendedprice", list(_PROBS), ["flag"], 2000).withColumn("quantile", r6("quantile"))


@query("SELECT round(quantile_cont(l_extendedprice::DOUBLE / l_quantity::DOUBLE, 0.5), 6) AS median FROM lineitem")
def quantile_of_all(spark, sf):
    df = fx.table(spark, sf, "lineitem").select((F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("v"))
    return quantiles.exact_quantiles(df, "v", [0.5], in_bracket=1000).select(r6("quantile").alias("median"))


_JENKS = """, x AS (SELECT v, n, row_number() OVER (ORDER BY v) AS i, sum(n) OVER (ORDER BY v) AS w, sum(n * v) OVER (ORDER BY v) AS s, sum(n * v * v) OVER (ORDER BY v) AS q FROM (SELECT v, count(*) AS n FROM (SELECT c_custkey, floor(c_acctbal / 40) - (SELECT avg(floor(c_acctbal / 40)) FROM customer) AS v FROM customer) GROUP BY 1)),
n AS (SELECT max(i) AS n, max(w) AS w, max(s) AS s, max(q) AS q FROM x),
best AS (SELECT a.v AS u, b.v AS v FROM x a JOIN x b ON a.i < b.i, n WHERE b.i < n.n ORDER BY a.q - a.s * a.s / a.w + (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.w - a.w) + (n.q - b.q) - (n.s - b.s) * (n.s - b.s) / (n.w - b.w) LIMIT 1)
SELECT CAST(1 + (c.v > u)::INT + (c.v > best.v)::INT AS INTEGER) AS bin, count(*) AS n FROM (SELECT floor(c_acctbal / 40) - (SELECT avg(floor(c_acctbal / 40)) FROM customer) AS v FROM customer) c, best GROUP BY 1"""


@query(_JENKS)
def natural_bins_of_customers(spark, sf):
    df = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("iso3c"), F.floor(F.col("c_acctbal") / 40).cast("double").alias("v"))
    return viz_prep.world_map(df, "v", "jenks", 3).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT iso3c, year, round(gdp, 2) AS gdp, round(lag(gdp) OVER w, 2) AS gdp_lag, round(gdp / lag(gdp) OVER w - 1, 8) AS gdp_growth,
  round(CASE WHEN year >= 1995 THEN gdp / max(CASE WHEN year = 1995 THEN gdp END) OVER (PARTITION BY iso3c) * 100 END, 6) AS gdp_index FROM panel WINDOW w AS (PARTITION BY iso3c ORDER BY year)""")
def streamed_panel(spark, sf):
    """Orders replayed out of order, file after file, through the stateful panel."""
    who = resolve.resolved(fx.people(spark, sf), "country").select("c_custkey", "iso3c")
    orders = fx.table(spark, sf, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select("iso3c", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("double").alias("gdp"), F.col("o_orderdate").cast("timestamp").alias("at"))
    folder = new_folder(spark, "orders")
    rows.repartition(4, F.xxhash64("gdp")).sortWithinPartitions(F.xxhash64("gdp", "iso3c")).write.parquet(folder)
    # a last file that only moves the time on
    spark.range(1).select(F.lit(None).cast("string").alias("iso3c"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("double").alias("gdp"), F.lit("2200-01-01").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"panel_{uuid.uuid4().hex}"
    panel_stream(stream, "gdp", "at", 1995, "5000 days").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    digits = {"gdp": 2, "gdp_lag": 2, "gdp_growth": 8, "gdp_index": 6}
    return spark.table(name).select("iso3c", "year", *[r6(c, n).alias(c) for c, n in digits.items()])


@query("SELECT c_mktsegment AS region, round(median(c_acctbal::DOUBLE), 6) AS balance FROM customer GROUP BY 1")
def median_of_segments(spark, sf):
    df = fx.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("region"), F.col("c_acctbal").alias("balance"))
    return quantiles.exact_median(df, "balance", ["region"]).withColumn("balance", r6("balance"))
