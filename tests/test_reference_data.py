import pytest

from isospan.errors import SpineError, UnsupportedScheme
from isospan.operators import resolve
from isospan.refdata import country_codes, country_groups, country_overrides, crosswalk, historical_codes


def names(spark, values, **kw):
    return resolve.convert_values(spark, values, **kw)


ACCEPT = {
    "U.S.": "USA", "S. Korea": "KOR", "Czechia": "CZE", "Kosovo": "XKX", "Micronesia": "FSM", "Virgin Islands": "VIR", "Canary Islands": "ESP",
    "Saint Martin": "MAF", "Czech Republic": "CZE", "Korea, Rep.": "KOR", "South Korea": "KOR", "Korea": "KOR", "United States": "USA", "Brazil": "BRA",
    "Kenya": "KEN", "USA": "USA", "Cote d'Ivoire": "CIV", "Yugoslavia": None, "Wakanda": None, "USSR": "RUS", "Sudan": "SDN", "Atlantis": None,
    "Russia": "RUS", "Russian Federation": "RUS", "UK": "GBR", "US": "USA", "United States of America": "USA", "America": "USA", "Côte d’Ivoire": "CIV",
    "Congo, Dem. Rep.": "COD", "Congo, Rep.": "COG", "Viet Nam": "VNM", "Lao PDR": "LAO", "Türkiye": "TUR", "Bosnia and Herzegovina": "BIH",
    "St. Lucia": "LCA", "The Gambia": "GMB", "Hong Kong SAR, China": "HKG", "North Korea": "PRK", "Niger": "NER", "Nigeria": "NGA", None: None, "": None,
}


def test_resolver_acceptance(spark):
    got = dict(zip(ACCEPT, names(spark, list(ACCEPT))))
    assert {k: (got[k], v) for k, v in ACCEPT.items() if got[k] != v} == {}


def test_conversions(spark):
    assert names(spark, ["Japan", "Brazil"], to="flag") == ["\U0001f1ef\U0001f1f5", "\U0001f1e7\U0001f1f7"]
    assert names(spark, ["Germany"], to="currency") == ["EUR"]
    assert names(spark, ["USA", "France"], to="continent") == ["Americas", "Europe"]
    assert names(spark, ["Germany"], to="name_fr") == ["Allemagne"] and names(spark, ["Germany"], to="name_es") == ["Alemania"]
    assert names(spark, ["Japan", "Brazil"], to="name_de") == ["Japan", "Brasilien"]
    assert names(spark, ["Canary Islands"], to="name_fr") == ["Espagne"]
    assert names(spark, ["Azores", "Canary Islands"], to="continent") == ["Europe", "Europe"]
    assert names(spark, ["Canary Islands", "Kosovo"], to="region") == ["Europe & Central Asia"] * 2
    assert [names(spark, ["Kosovo"], to=t)[0] for t in ("continent", "iso2c", "flag", "country", "currency")] == ["Europe", "XK", "\U0001f1fd\U0001f1f0", "Kosovo", None]
    assert names(spark, ["XKX"], to="continent", origin="iso3c") == ["Europe"] and names(spark, ["XKX"], to="flag", origin="iso3c") == [None]
    assert names(spark, ["US", "kr", "BR"], origin="iso2c") == ["USA", "KOR", "BRA"]
    assert names(spark, [" usa ", "zzz"], origin="iso3c") == ["USA", "ZZZ"]
    with pytest.raises(UnsupportedScheme):
        names(spark, ["USA"], to="calling_code")


def test_overrides():
    assert len(country_overrides()) == 25
    assert country_overrides({"Kosovo": "SRB", "X": "Y"})["Kosovo"] == "SRB"
    for bad in (["a"], {"": "X"}):
        with pytest.raises(SpineError):
            country_overrides(bad)


def test_groups(spark):
    want = {"EU": 27, "EuroZone": 20, "G7": 7, "G20": 19, "BRICS": 5, "ASEAN": 10, "EFTA": 4, "OPEC": 13, "NATO": 31, "OECD": 38, "Commonwealth": 55, "Mercosur": 5, "GCC": 6, "Nordic": 5, "Visegrad": 4}
    got = {r["group"]: r["count"] for r in country_groups(spark).groupBy("group").count().collect()}
    assert got == want and country_groups(spark).where("country is null").count() == 0
    with pytest.raises(SpineError, match="Nordic"):
        country_groups(spark, "Nope").count()
    df = spark.createDataFrame([("Denmark",), ("Peru",), (None,)], "c string")
    assert [r.in_group for r in resolve.in_group(df, "c", "Nordic").collect()] == [True, False, False]


def test_crosswalk(spark):
    cw = crosswalk(spark)
    assert cw.count() > 240 and cw.select("iso3c").distinct().count() == cw.count()
    assert cw.where("landlocked").count() == 44
    from isospan.refdata.crosswalk import REGIONS

    listed = [c for codes in REGIONS.values() for c in codes.split()]
    assert len(listed) == len(set(listed))
    missing = cw.where("region is null").select("iso3c").collect()
    assert {r[0] for r in missing} <= {"ATA", "ATF", "BVT", "HMD", "SGS", "UMI"}
    assert country_codes(spark, ["flag", "nope"]).columns == ["country", "iso3c", "flag"]


def test_historical(spark):
    h = historical_codes(spark)
    assert h.count() == 41 and h.select("historical").distinct().count() == 14 and h.where("country is null").count() == 0


def test_regions(spark):
    assert "XKX" in resolve.region_codes(spark, "Europe") and len(resolve.region_codes(spark, "G7")) == 7
    assert resolve.region_codes(spark, ["FRA", "DEU"]) == ["FRA", "DEU"] and resolve.region_codes(spark, ["France"]) == ["FRA"]
    assert resolve.region_codes(spark, [0, 0, 1, 1]) is None
    with pytest.raises(SpineError):
        resolve.region_codes(spark, "Atlantis")
