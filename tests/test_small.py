"""Functions of arguments alone, which run on the driver."""

import json

import pytest

from isospan.errors import SpineError, one_of
from isospan.functions.geo import PROJECTIONS, projection_string
from isospan.functions.stats import t_two_sided
from isospan.functions.text import si_label
from isospan.operators import aggregate, viz_prep
from isospan.sinks import world_query
from isospan.sources import geometry, indicators, world


def test_years_and_names():
    assert world.validate_years([2000.4, 1999, 1999, 2001]) == [1999, 2000, 2001]
    for wrong in ([1959], ["x"]):
        with pytest.raises(SpineError):
            world.validate_years(wrong)
    assert indicators.normalize_indicator(["NY.GDP.PCAP.CD", "SP POP-TOTL", "a_b"]) == {"NY.GDP.PCAP.CD": "NY.GDP.PCAP.CD", "SP.POP.TOTL": "SP POP-TOTL", "a_b": "a_b"}


def test_wrong_arguments(spark):
    with pytest.raises(SpineError):
        one_of("method", "median", ("mean", "sum"))
    with pytest.raises(SpineError):
        aggregate.gini(spark.createDataFrame([("FRA", 1.0)], "iso3c string, v double"), "gdp")


def test_labels_and_scales():
    assert [si_label(x) for x in (1500.0, 4e6, 2e9, 3.2e12, 12.0, -2500.0)] == ["1.5K", "4M", "2B", "3.2T", "12", "-2.5K"]
    assert [geometry.map_scale(n) for n in ("small", "medium", "large")] == [110, 50, 10]
    assert viz_prep.globe_frames(60) == [6.0 * i for i in range(60)]


def test_projection_strings():
    # The names of projections in their strings.
    names = {"equirectangular": "eqc", "robinson": "robin", "natural_earth": "natearth", "equal_earth": "eqearth", "mollweide": "moll", "mercator": "merc", "winkel_tripel": "wintri", "eckert4": "eck4", "orthographic": "ortho", "laea": "laea", "albers": "aea", "lambert_cylindrical": "cea", "gall_peters": "cea"}
    assert set(PROJECTIONS) == set(names)
    for p, short in names.items():
        got = projection_string(p)
        assert got.startswith(f"+proj={short} +lon_0=0") and got.endswith("+datum=WGS84 +units=m +no_defs")
    assert "+lat_1=29.5 +lat_2=45.5" in projection_string("albers") and "+lat_ts=45" in projection_string("gall_peters") and "+lat_0=0" in projection_string("laea")


def test_chart_texts():
    text = world_query("gdp", projection="robinson", palette="viridis", transform="log", title="World's GDP")
    assert text.sql() == "VISUALISE gdp AS fill\nFROM world\nDRAW spatial\nPROJECT TO robinson\nSCALE fill TO viridis VIA log\nLABEL title => 'World''s GDP'"
    spec = json.loads(viz_prep.chart_spec("world.json", "gdp", tooltip=["country"]))
    assert spec["encoding"]["color"]["field"] == "gdp" and spec["encoding"]["color"]["scale"]["scheme"] == "viridis" and spec["projection"]["type"] == "equalEarth"
    assert spec["mark"]["type"] == "geoshape" and spec["encoding"]["tooltip"][0]["field"] == "country"
    theme = viz_prep.theme()
    assert (theme["font"], theme["legend"]["labelFontSize"], theme["title"]["fontSize"]) == ("sans-serif", 9, 14)


def test_t_probabilities():
    for t, n, p in ((2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1000000, 0.05), (0.0, 7, 1.0), (2.0, 2, 0.183503), (-2.845340, 20, 0.01)):
        assert t_two_sided(t, n) == pytest.approx(p, abs=2e-5)
