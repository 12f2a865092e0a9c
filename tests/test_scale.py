"""Operators whose work is cut by size, held against plain ones."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from isospan.errors import SpineError
from isospan.functions.stats import natural_breaks
from isospan.operators import aggregate, panel, prefix, viz_prep
from isospan.operators.quantiles import exact_quantiles
from isospan.streaming.panel import panel_stream


def plain_breaks(values, k, weights):
    """The whole programme: least sum of squares over every cut."""
    pairs = {}
    for v, w in zip(values, weights):
        pairs[v] = pairs.get(v, 0) + w
    x = sorted(pairs)
    k = min(k, len(x))

    def spread(i, j):
        n = sum(pairs[v] for v in x[i:j])
        m = sum(pairs[v] * v for v in x[i:j]) / n
        return sum(pairs[v] * (v - m) ** 2 for v in x[i:j])

    table = {(i, j): spread(i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    best = {(1, j): (table[0, j], [x[j - 1]]) for j in range(1, len(x) + 1)}
    for c in range(2, k + 1):
        for j in range(c, len(x) + 1):
            best[c, j] = min(((best[c - 1, i][0] + table[i, j], [*best[c - 1, i][1], x[j - 1]]) for i in range(c - 1, j)), key=lambda t: t[0])
    return best[k, len(x)][0], sorted({x[0], *best[k, len(x)][1]}), table, x


def test_natural_breaks_against_the_whole_programme():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 25)
        values, weights = [float(rng.randint(-50, 50)) for _ in range(n)], [rng.randint(1, 5) for _ in range(n)]
        k = rng.randint(1, 6)
        cost, limits, table, x = plain_breaks(values, k, weights)
        got = natural_breaks(values, k, weights)
        ends = [x.index(v) + 1 for v in got]
        ends = ends if got[0] == limits[0] and len(got) == min(k, len(x)) else ends[1:]
        assert sum(table[i, j] for i, j in zip([0, *ends], ends)) == pytest.approx(cost, abs=1e-9)
    assert natural_breaks([], 3) == []


def test_natural_breaks_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.col("id").cast("string").alias("iso3c"), (F.col("id") + F.when(F.col("id") >= 400_000, 5_000_000).otherwise(0)).alias("v"))
    assert viz_prep.compute_breaks(df, "v", "jenks", 2) == [0.0, 399_999.0, 5_999_999.0]


def test_natural_breaks_stop_beyond_their_bound(spark, monkeypatch):
    monkeypatch.setattr(viz_prep, "JENKS_VALUES", 4)
    with pytest.raises(SpineError, match="distinct"):
        viz_prep.compute_breaks(spark.range(5).select(F.col("id").cast("string").alias("iso3c"), F.col("id").alias("v")), "v", "jenks")


@pytest.mark.parametrize("in_bracket", [20, 1_000_000])
def test_exact_quantiles(spark, in_bracket):
    rng = random.Random(4)
    rows = [("big" if rng.random() < 0.8 else rng.choice(["a", None]), rng.choice([0.0, 0.0, rng.gauss(0, 1), 10 ** rng.uniform(-200, 200), float(rng.randint(0, 9))])) for _ in range(6000)]
    rows += [("one", 3.0), ("none", None), ("none", float("nan")), ("same", 7.0)] + [("same", 7.0)] * 200
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.9995, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", probs, ["g"], in_bracket).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert set(got) == {(g, p) for g in groups for p in probs}
    for (g, p), q in got.items():
        assert q == pytest.approx(float(np.quantile(groups[g], p)), rel=1e-12)
    whole = [v for own in groups.values() for v in own]
    out = {r["prob"]: r["quantile"] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.5, 0.1], in_bracket=in_bracket).collect()}
    assert out == pytest.approx({p: float(np.quantile(whole, p)) for p in (0.1, 0.5)})
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), "v", [0.5], ["g"]).count() == 0


def test_median_and_breaks_of_large_groups(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"c{i}", rng.choice("xy"), rng.random() if i % 9 else None) for i in range(2000)] + [("z", "empty", None)]
    df = spark.createDataFrame(rows, "iso3c string, region string, v double")
    want = aggregate.aggregate_regions(df, "v", "region", "median").collect(), viz_prep.compute_breaks(df, "v", "quantile", 7)
    monkeypatch.setattr(prefix, "WINDOW_ROWS", 10)
    assert aggregate.aggregate_regions(df, "v", "region", "median").collect() == want[0]
    assert viz_prep.compute_breaks(df, "v", "quantile", 7) == pytest.approx(want[1])
    assert want[0][-1]["v"] == pytest.approx(statistics.median(v for _, g, v in rows if g == "y" and v is not None))


def replayed(spark, folder, files, late, **options):
    """The stream of one file after another; a last one only moves the time on."""
    schema = "iso3c string, year int, v double, at timestamp"
    for rows in [*files, [(None, None, None, datetime.datetime(2200, 1, 1))]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    name = f"panel_{folder.name}".replace("-", "_")
    panel_stream(stream, "v", "at", 2001, late, **options).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.table(name).collect()), key=str)


def at(year, month=6):
    return datetime.datetime(year, month, 1)


def test_streamed_panel_equals_the_batch_one(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, y, None if rng.random() < 0.1 else float(rng.randint(1, 99)), at(y, rng.randint(1, 12))) for c in ("FRA", "DEU", "KEN") for y in range(1998, 2006) for _ in range(3) if y != 2003]
    rng.shuffle(rows)
    got = replayed(spark, tmp_path / "all", [rows[i::4] for i in range(4)], "5000 days")
    df = spark.createDataFrame(rows, "iso3c string, year int, v double, at timestamp").groupBy("iso3c", "year").agg(F.sum("v").alias("v"))
    batch = panel.index_to(panel.growth_rate(panel.lag_by_country(df, "v"), "v"), "v", 2001)
    want = sorted((tuple(r) for r in batch.select("iso3c", "year", "v", "v_lag", "v_growth", F.when(F.col("year") >= 2001, F.col("v_index"))).collect()), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2:] == pytest.approx(b[2:], nan_ok=True)


def test_late_rows_of_a_told_year_are_dropped(spark, tmp_path):
    files = [[("FRA", 2000, 5.0, at(2000))], [("FRA", 2001, 10.0, at(2001))], [("FRA", 2002, 30.0, at(2002))], [("FRA", 2000, 99.0, at(2000)), ("FRA", 2002, 10.0, at(2002))]]
    got = replayed(spark, tmp_path / "late", files, "30 days")
    assert [r[:4] for r in got] == [("FRA", 2000, 5.0, None), ("FRA", 2001, 10.0, 5.0), ("FRA", 2002, 40.0, 10.0)]
    assert [r[5] for r in got] == [None, 100.0, 400.0]


def test_a_country_long_without_rows_starts_anew(spark, tmp_path):
    files = [[("FRA", 2000, 5.0, at(2000))], [("DEU", 2010, 1.0, at(2010))], [("DEU", 2011, 2.0, at(2011))], [("FRA", 2012, 7.0, at(2012)), ("DEU", 2012, 3.0, at(2012))]]
    got = replayed(spark, tmp_path / "idle", files, "30 days", forget_years=3)
    assert [r[:4] for r in got] == [("DEU", 2010, 1.0, None), ("DEU", 2011, 2.0, 1.0), ("DEU", 2012, 3.0, 2.0), ("FRA", 2000, 5.0, None), ("FRA", 2012, 7.0, None)]
