"""Registered queries of outlines made from the driver's tables.

Customers and suppliers have boxes and diamonds whose places follow from their
keys and whose sizes follow from their balances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query, r6
from .operators import cartogram, dorling, globe, nesting, overlay, viz_prep
from .plans import fixtures as fx
from .shared import cut
from .sinks.export import wkb_frame

BOX, DIAMOND = ((-1, -1), (1, -1), (1, 1), (-1, 1)), ((0, -1), (1, 0), (0, 1), (-1, 0))


def _spots(spark, sf, table: str, p: str, size: str) -> DataFrame:
    """(k, nation, x, y, r): where each row of a table lies, and its half-width.

    r is rounded as the SQL does it, in binary: Spark's round goes by decimal digits,
    which puts a half-way value apart now and then.
    """
    k = F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}")
    at = lambda m, n, less: F.round((k * m % n) / 10.0 - less, 2)
    return fx.table(spark, sf, table).select(k.alias("k"), F.col(f"{p}_nationkey").alias("nation"), at(7, 701, 30).alias("x"), at(11, 691, 29).alias("y"), (F.floor(F.expr(size) * 1000 + 0.5) / 1000).alias("r"))


def _shapes(spots: DataFrame, corners) -> DataFrame:
    points = F.array(*[F.struct(F.lit(i).alias("order"), (F.col("x") + F.col("r") * dx).alias("long"), (F.col("y") + F.col("r") * dy).alias("lat")) for i, (dx, dy) in enumerate(corners, 1)])
    return spots.select(F.col("k").cast("string").alias("iso3c"), "nation", F.col("k").cast("int").alias("group"), F.explode(points).alias("p")).select("iso3c", "nation", "group", "p.order", "p.long", "p.lat")


_SPOTS = "SELECT {p}_nationkey AS nation, round(({key} * 7 % 701)::DOUBLE / 10 - 30, 2) AS x, round(({key} * 11 % 691)::DOUBLE / 10 - 29, 2) AS y, round({size}, 3) AS r FROM {table}"
_C_SIZE, _S_SIZE = "0.5 + abs(c_acctbal) / 5000", "2 + abs(s_acctbal) / 1000"
_CUSTOMERS = _SPOTS.format(p="c", key="c_custkey", size=_C_SIZE, table="customer")
_SUPPLIERS = _SPOTS.format(p="s", key="s_suppkey", size=_S_SIZE, table="supplier")


def planar(frame: DataFrame, by: str) -> DataFrame:
    """(by, area, perimeter) of outlines whose holes turn the other way."""
    w = Window.partitionBy(by, "group").orderBy("order")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(ends))
    e = frame.select(by, "long", "lat", after("long").alias("nx"), after("lat").alias("ny"))
    return e.groupBy(by).agg(F.sum((F.col("long") * F.col("ny") - F.col("nx") * F.col("lat")) / 2).alias("area"), F.sum(F.sqrt(F.pow(F.col("nx") - F.col("long"), 2) + F.pow(F.col("ny") - F.col("lat"), 2))).alias("perimeter"))


def _cells(boxes: str, extra: str = "TRUE") -> str:
    """CTEs to cells(nation, x, nx, y, ny): the covered cells of each nation's boxes (x0, y0, x1, y1)."""
    return f""", b AS ({boxes}), xs AS (SELECT nation, v AS x, lead(v) OVER (PARTITION BY nation ORDER BY v) AS nx FROM (SELECT nation, x0 AS v FROM b UNION SELECT nation, x1 FROM b)),
ys AS (SELECT nation, v AS y, lead(v) OVER (PARTITION BY nation ORDER BY v) AS ny FROM (SELECT nation, y0 AS v FROM b UNION SELECT nation, y1 FROM b)),
cells AS (SELECT DISTINCT nation, xs.x, nx, ys.y, ny FROM b JOIN xs USING (nation) JOIN ys USING (nation) WHERE xs.x >= x0 AND nx <= x1 AND ys.y >= y0 AND ny <= y1 AND {extra}) """


@query(_cells(f"SELECT nation, x - r AS x0, x + r AS x1, y - r AS y0, y + r AS y1 FROM ({_CUSTOMERS})") + """
SELECT nation, round(sum((nx - x) * (ny - y)), 3) AS area, round(sum(
  (ny - y) * ((NOT EXISTS (SELECT 1 FROM cells d WHERE d.nation = c.nation AND d.nx = c.x AND d.y = c.y))::INT + (NOT EXISTS (SELECT 1 FROM cells d WHERE d.nation = c.nation AND d.x = c.nx AND d.y = c.y))::INT) +
  (nx - x) * ((NOT EXISTS (SELECT 1 FROM cells d WHERE d.nation = c.nation AND d.ny = c.y AND d.x = c.x))::INT + (NOT EXISTS (SELECT 1 FROM cells d WHERE d.nation = c.nation AND d.y = c.ny AND d.x = c.x))::INT)), 3) AS perimeter FROM cells c GROUP BY nation""")
def outline_union(spark, sf):
    boxes = _shapes(_spots(spark, sf, "customer", "c", _C_SIZE), BOX)
    return planar(overlay.union_outlines(boxes, "nation"), "nation").withColumns({"area": r6("area", 3), "perimeter": r6("perimeter", 3)})


def _in_mask(inside: bool) -> str:
    """Diamonds are boxes in x + y and x - y, twice as large."""
    diamonds = "SELECT {n} AS nation, x + y - r AS x0, x + y + r AS x1, x - y - r AS y0, x - y + r AS y1 FROM ({t})"
    own, mask = diamonds.format(n="nation", t=_CUSTOMERS), diamonds.format(n="0", t=_SUPPLIERS)
    return f""", b AS ({own}), m AS ({mask}), xv AS (SELECT x0 AS v FROM m UNION SELECT x1 FROM m), yv AS (SELECT y0 AS v FROM m UNION SELECT y1 FROM m),
xs AS (SELECT nation, v AS x, lead(v) OVER (PARTITION BY nation ORDER BY v) AS nx FROM (SELECT nation, x0 AS v FROM b UNION SELECT nation, x1 FROM b UNION SELECT DISTINCT nation, v FROM b, xv)),
ys AS (SELECT nation, v AS y, lead(v) OVER (PARTITION BY nation ORDER BY v) AS ny FROM (SELECT nation, y0 AS v FROM b UNION SELECT nation, y1 FROM b UNION SELECT DISTINCT nation, v FROM b, yv)),
cells AS (SELECT DISTINCT nation, xs.x, nx, ys.y, ny FROM b JOIN xs USING (nation) JOIN ys USING (nation) WHERE xs.x >= x0 AND nx <= x1 AND ys.y >= y0 AND ny <= y1)
SELECT nation, round(sum((nx - x) * (ny - y)) / 2, 3) AS area FROM cells c WHERE {'' if inside else 'NOT'} EXISTS (SELECT 1 FROM m WHERE c.x >= m.x0 AND c.nx <= m.x1 AND c.y >= m.y0 AND c.ny <= m.y1) GROUP BY nation"""


def _masked(spark, sf, how):
    own, mask = (_shapes(_spots(spark, sf, *t), DIAMOND) for t in (("customer", "c", _C_SIZE), ("supplier", "s", _S_SIZE)))
    return planar(overlay.overlay(own, "nation", mask, how), "nation").select("nation", r6("area", 3).alias("area"))


@query(_in_mask(True))
def outline_clip(spark, sf):
    return _masked(spark, sf, "intersection")


@query(_in_mask(False))
def outline_difference(spark, sf):
    return _masked(spark, sf, "difference")


# -- rings within rings: segments of each nation's customers, larger totals around smaller ---

_RINGS = """, t AS (SELECT c_nationkey AS n, c_mktsegment AS seg, round(1 + CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / 100000, 6) AS r FROM customer GROUP BY 1, 2 HAVING sum(c_acctbal) > 0),
ranked AS (SELECT s.iso3c, n, seg, r, row_number() OVER (PARTITION BY n ORDER BY r DESC) - 1 AS depth, lag(seg) OVER (PARTITION BY n ORDER BY r DESC) AS around FROM t JOIN spine s ON n = n_nationkey) """


def _ring_frame(spark, sf) -> DataFrame:
    """A square for each nation and segment around the nation's middle, by turns left and right."""
    t = fx.table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("v")).where("v > 0")
    s = fx.spine(spark).select(F.col("n_nationkey").alias("c_nationkey"), "iso3c")
    spots = t.join(F.broadcast(s), "c_nationkey").select("iso3c", "c_nationkey", F.col("c_mktsegment").alias("group"), ((F.col("c_nationkey") * 37) % 340 - 169.5).cast("double").alias("x"), ((F.col("c_nationkey") * 23) % 140 - 69.75).cast("double").alias("y"), F.round(1 + F.col("v") / 100000, 6).alias("r"))
    turn = F.when(F.length("group") % 2 == 0, 1.0).otherwise(-1.0)
    corners = F.array(*[F.struct(F.lit(i).alias("order"), (F.col("x") + F.col("r") * dx * turn).alias("long"), (F.col("y") + F.col("r") * dy).alias("lat")) for i, (dx, dy) in enumerate(BOX, 1)])
    return spots.select("iso3c", "group", F.explode(corners).alias("p")).select("iso3c", "group", "p.order", "p.long", "p.lat")


@query(_RINGS + 'SELECT iso3c, seg AS "group", CAST(depth AS INTEGER) AS depth, around AS parent, round(4 * r * r, 4) AS area FROM ranked')
def ring_nesting(spark, sf):
    return nesting.nested_rings(_ring_frame(spark, sf)).select("iso3c", "group", "depth", "parent", r6(F.abs("area"), 4).alias("area"))


@query(_RINGS + """, p AS (SELECT iso3c, count(*) AS n, min(seg) FILTER (WHERE depth % 2 = 0) AS first FROM ranked GROUP BY 1)
SELECT iso3c, CAST(9 + (n + 1) // 2 * 9 + n * 84 AS INTEGER) AS bytes, '0106000000' || lpad(to_hex((n + 1) // 2), 2, '0') || '000000' || '0103000000' || CASE WHEN EXISTS (SELECT 1 FROM ranked r WHERE r.iso3c = p.iso3c AND around = first AND depth % 2 = 1) THEN '02' ELSE '01' END || '000000' AS head,
  (SELECT round(sum(CASE WHEN depth % 2 = 0 THEN 4 * r * r ELSE -4 * r * r END), 4) FROM ranked r WHERE r.iso3c = p.iso3c) AS area FROM p""")
def wkb_with_holes(spark, sf):
    frame = _ring_frame(spark, sf)
    ring = lambda r: nesting.signed_area(r)
    area = nesting.polygons(frame).select("iso3c", F.aggregate(F.transform(F.flatten("parts"), ring), F.lit(0.0), lambda a, v: a + v).alias("area"))
    made = wkb_frame(frame).select("iso3c", F.octet_length("geometry").alias("bytes"), F.substring(F.hex("geometry"), 1, 36).alias("head"))
    return made.join(area, "iso3c").withColumn("area", r6("area", 4))


# -- the visible side of a globe: customers' boxes seen from 100 east, 10 north --------------

_SEEN = "sin(radians(10)) * sin(radians({y})) + cos(radians(10)) * cos(radians({y})) * cos(radians({x} - 100)) >= 0"


@query(f""", c AS ({_CUSTOMERS}), v AS (SELECT nation, CASE WHEN {_SEEN.format(x='x - r', y='y - r')} THEN 1 ELSE 0 END AS a, CASE WHEN {_SEEN.format(x='x + r', y='y - r')} THEN 1 ELSE 0 END AS b, CASE WHEN {_SEEN.format(x='x + r', y='y + r')} THEN 1 ELSE 0 END AS d, CASE WHEN {_SEEN.format(x='x - r', y='y + r')} THEN 1 ELSE 0 END AS e FROM c)
SELECT nation, sum(a + b + d + e) AS own, count(*) FILTER (WHERE a + b + d + e BETWEEN 1 AND 3) AS cut, count(*) FILTER (WHERE a + b + d + e = 4) AS whole, true AS visible FROM v WHERE a + b + d + e > 0 GROUP BY 1""")
def globe_clipped(spark, sf):
    boxes = _shapes(_spots(spark, sf, "customer", "c", _C_SIZE), BOX)
    out = viz_prep.globe_view(globe.clip_globe(boxes, 100.0, 10.0), 100.0, 10.0)
    per = out.groupBy("nation", "group").agg(F.sum((~F.col("limb")).cast("long")).alias("own"), F.max("limb").alias("cut"), F.min("visible").alias("visible"))
    return per.groupBy("nation").agg(F.sum("own").alias("own"), F.sum(F.col("cut").cast("long")).alias("cut"), F.sum((~F.col("cut")).cast("long")).alias("whole"), F.min("visible").alias("visible"))


# -- contiguous cartogram: weights from orders ------------------------------------------------

_ROUNDS = 3


def _cartogram_sql() -> str:
    parts = [""", w AS (SELECT iso3c, CAST(sum(CAST(gdp AS DECIMAL(38,2))) AS DOUBLE) AS w FROM panel GROUP BY 1), v0 AS (SELECT iso3c, "group" AS g, "order" AS o, long AS x, lat AS y FROM ring)"""]
    for i in range(_ROUNDS):
        parts.append(f"""n{i} AS (SELECT *, coalesce(lead(x) OVER k, first_value(x) OVER k) AS nx, coalesce(lead(y) OVER k, first_value(y) OVER k) AS ny FROM v{i} WINDOW k AS (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a{i} AS (SELECT iso3c, sum(x * ny - nx * y) / 2 AS a, sum((x + nx) * (x * ny - nx * y)) / (3 * sum(x * ny - nx * y)) AS cx, sum((y + ny) * (x * ny - nx * y)) / (3 * sum(x * ny - nx * y)) AS cy FROM n{i} GROUP BY 1),
d{i} AS (SELECT iso3c, a, cx, cy, w / sum(w) OVER () * sum(a) OVER () AS d FROM a{i} JOIN w USING (iso3c)),
f{i} AS (SELECT cx, cy, sqrt(a / pi()) AS r, sqrt(d / pi()) - sqrt(a / pi()) AS m, 1 / (1 + avg(greatest(a, d) / least(a, d)) OVER ()) AS q FROM d{i}),
p{i} AS (SELECT iso3c, g, o, x, y, cx, cy, r, m, q, greatest(sqrt((x - cx) ** 2 + (y - cy) ** 2), 1e-12) AS t FROM v{i}, f{i}),
v{i + 1} AS (SELECT iso3c, g, o, x + sum(u * (x - cx)) AS x, y + sum(u * (y - cy)) AS y FROM (SELECT *, m * CASE WHEN t > r THEN r / t ELSE (t / r) ** 2 * (4 - 3 * t / r) END / t * q AS u FROM p{i}) GROUP BY iso3c, g, o, x, y)""")
    return ", ".join(parts) + f' SELECT iso3c, g AS "group", o AS "order", round(x, 6) AS long, round(y, 6) AS lat FROM v{_ROUNDS}'


@query(_cartogram_sql())
def cartogram_contiguous(spark, sf):
    totals = fx.panel(spark, sf).groupBy("iso3c").agg(F.sum(F.col("gdp").cast("decimal(38,2)")).cast("double").alias("gdp"))
    out, _ = cartogram.contiguous_cartogram(totals, "gdp", fx.ring(spark), _ROUNDS)
    return out.select("iso3c", "group", "order", r6("long").alias("long"), r6("lat").alias("lat"))


_WORTH = "(SELECT o_custkey, round(sum(o_totalprice)::DOUBLE, 2) AS w FROM orders GROUP BY 1)"


_CROWDED = f"(SELECT c_custkey AS k, c_nationkey AS nation, w, (c_custkey * 7919 % 10007) / 10007 * sqrt(n) AS x, (c_custkey * 6007 % 9973) / 9973 * sqrt(n) AS y FROM customer JOIN {_WORTH} ON o_custkey = c_custkey, (SELECT count(*) AS n FROM customer))"


@query(f"""SELECT nation, count(*) AS circles, 0::BIGINT AS overlapping, round(sum(0.36 * w / top), 6) AS squares, any_value(round(mean_x, 4)) AS mean_x, any_value(round(mean_y, 4)) AS mean_y
FROM {_CROWDED}, (SELECT max(w) AS top, avg(x) AS mean_x, avg(y) AS mean_y FROM {_CROWDED}) GROUP BY 1""")
def circles_of_orders(spark, sf):
    """A circle per customer by the worth of its orders: none overlaps, squares and the mean place stay."""
    worth = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum(F.col("o_totalprice")).cast("double"), 2).alias("w"))
    customers = fx.table(spark, sf, "customer")
    k, side = F.col("c_custkey"), F.sqrt(F.col("n"))
    at = customers.crossJoin(F.broadcast(customers.agg(F.count(F.lit(1)).alias("n")))).select(k.alias("k"), (k * 7919 % 10007 / 10007 * side).alias("x"), (k * 6007 % 9973 / 9973 * side).alias("y")).join(worth, "k")
    out = cut(dorling.dorling_layout(at, "w", "k", "x", "y", k=0.6))
    # overlaps by squares as wide as the largest circle: a plainer search than the layout's own
    cell = lambda c: F.floor(F.col(c) / 1.2)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = out.select(*[F.col(c).alias(f"{c}_a") for c in out.columns], cell("x").alias("i"), cell("y").alias("j"))
    b = out.withColumn("i", around("x")).withColumn("j", around("y"))
    over = a.join(b, ["i", "j"]).where("k <> k_a and sqrt(pow(x - x_a, 2) + pow(y - y_a, 2)) < r + r_a - 1e-5").select("k").distinct().withColumn("over", F.lit(1))
    nation = customers.select(F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").alias("nation"))
    per = nation.join(out, "k").join(over, "k", "left").groupBy("nation").agg(F.count(F.lit(1)).alias("circles"), F.count("over").alias("overlapping"), r6(F.sum(F.col("r") * F.col("r"))).alias("squares"))
    return per.crossJoin(F.broadcast(out.agg(r6(F.avg("x"), 4).alias("mean_x"), r6(F.avg("y"), 4).alias("mean_y"))))
