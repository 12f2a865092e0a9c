import struct
import warnings

import duckdb
import pytest

from isospan.errors import SpineError, SpineWarning
from isospan.functions.text import jaro, si_label, valid_name
from isospan.refdata import common_indicators, indicator_search
from isospan.sinks import as_source, world_query
from isospan.sources import country_data, fetch_indicators, register, square_grid, validate_years, world_data, world_geometry
from isospan.streaming import standardize_stream

ROWS = [("USA", "US", "United States", 2019, 1.0), ("USA", "US", "United States", 2020, None), ("FRA", "FR", "France", 2020, 3.0), (None, "1W", "World", 2020, 9.0)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("indicators")
    df = spark.createDataFrame(ROWS, "iso3c string, iso2c string, country string, year int, value double")
    df.write.parquet(f"{path}/A.B")
    df.where("iso3c = 'USA' or iso3c is null").selectExpr("iso3c", "iso2c", "country", "year", "value * 10 as value").write.parquet(f"{path}/C.D")
    return str(path)


def test_data_source(spark, root):
    register(spark)
    df = spark.read.format("indicators").option("codes", "A.B,C.D,NO").load(root)
    assert df.count() == 7 and df.where("year = 2020 and code = 'A.B'").count() == 3


def test_fetch_and_country_data(spark, root, tmp_path):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        got = fetch_indicators(spark, root, {"a": "A.B", "c": "C.D", "x": "NO"}, 2019, 2020, str(tmp_path))
        assert any(issubclass(w.category, SpineWarning) for w in seen)
    rows = {(r.iso3c, r.year): (r.country, r.a, r.c, r.x) for r in got.collect()}
    assert rows == {("USA", 2019): ("United States", 1.0, 10.0, None), ("USA", 2020): ("United States", None, None, None), ("FRA", 2020): ("France", 3.0, None, None)}
    table = country_data(spark, root, 2020, {"a": "A.B"}, latest=True, lookback_years=3)
    assert {r.iso3c: (r.a, r.continent) for r in table.collect()} == {"USA": (1.0, "Americas"), "FRA": (3.0, "Europe")}
    panel = country_data(spark, root, [2019, 2020], {"a": "A.B"}, panel=True)
    assert panel.columns[:6] == ["iso3c", "iso2c", "country", "year", "continent", "region"] and panel.count() == 3
    spine = country_data(spark, None, [2019, 2020], panel=True)
    assert spine.count() > 480
    world = world_data(spark, root, 2020, {"a": "A.B"}, geometry=square_grid(spark, ["USA", "FRA", "PER"]))
    assert world.count() == 12 and world.where("a is not null").count() == 4


def test_years():
    assert validate_years([2000.4, 1999, 2000]) == [1999, 2000]
    for bad in ([1900], [3000], [], ["x"]):
        with pytest.raises(SpineError):
            validate_years(bad)


def test_query_text():
    text = world_query("gdp", projection="robinson", palette="viridis", transform="log", title="World's GDP")
    assert text.sql().split("\n") == ["VISUALISE gdp AS fill", "FROM world", "DRAW spatial", "PROJECT TO robinson", "SCALE fill TO viridis VIA log", "LABEL title => 'World''s GDP'"]
    assert "VIA" not in world_query("gdp", transform="log")


def test_sinks(spark, tmp_path):
    frame = square_grid(spark, ["USA", "FRA"])
    assert as_source(frame, "v") == "v" and spark.table("v").count() == 2
    table = as_source(frame, format="arrow")
    wkb = {r["iso3c"]: r["geometry"] for r in table.to_pylist()}["USA"]
    assert struct.unpack("<BII", wkb[:9]) == (1, 6, 1) and struct.unpack("<I", wkb[14:18]) == (1,) and struct.unpack("<I", wkb[18:22])[0] == 5 or struct.unpack("<BIII", wkb[9:22]) == (1, 3, 1, 5)
    path = as_source(spark.createDataFrame([("USA", 1)], "iso3c string, v int"), format="parquet", path=f"{tmp_path}/t")
    assert spark.read.parquet(path).count() == 1
    con = duckdb.connect()
    assert as_source(frame, "w", "duckdb", con=con) == "w" and con.execute("select count(*) from w").fetchall() == [(2,)]
    for bad in (dict(format="parquet"), dict(format="duckdb"), dict(format="xls")):
        with pytest.raises(SpineError):
            as_source(frame, **bad)


def test_search_and_text(spark):
    cat = common_indicators(spark).selectExpr("code as indicator", "description as name")
    assert cat.count() == 20 and indicator_search(cat, "gini").count() == 1 and indicator_search(cat, r"^SP\.", "indicator").count() == 5
    assert si_label(4e6) == "4M" and si_label(2e9) == "2B" and si_label(None) is None
    assert valid_name("a b-c.d") == "a.b.c.d"
    assert abs(1 - jaro("Wakanda", "Canada") - 0.2175) < 1e-3 and abs(1 - jaro("Germny", "Germany") - 0.0476) < 1e-3 and jaro("", "a") == 0


def test_geometry_kinds(spark):
    frame = square_grid(spark, ["USA", "CAN"])
    assert world_geometry(frame, "coastline").count() == 6 and world_geometry(frame, "borders").count() == 1
    assert world_geometry(frame, "ocean").where("not hole").count() == 4 and world_geometry(frame, "ocean").where("hole").count() == 8 and world_geometry(frame, "graticule").count() > 1000
    with pytest.raises(SpineError):
        world_geometry(frame, "moon")


def test_stream(spark, tmp_path):
    spark.createDataFrame([("U.S.", 1), ("Wakanda", 2)], "c string, v int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("c string, v int").parquet(f"{tmp_path}/in")
    q = standardize_stream(stream, "c", add=("continent",)).writeStream.format("memory").queryName("coded").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.v, r.iso3c, r.continent) for r in spark.table("coded").collect()) == [(1, "USA", "Americas"), (2, None, None)]
