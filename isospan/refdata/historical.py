"""Dissolved entities and their successors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crosswalk import crosswalk

# Entity, code it held, year it ceased, successors.
ENTITIES = [
    ("Soviet Union", "SUN", 1991, "ARM AZE BLR EST GEO KAZ KGZ LVA LTU MDA RUS TJK TKM UKR UZB"),
    ("Yugoslavia", "YUG", 1992, "BIH HRV MKD MNE SRB SVN XKX"),
    ("Serbia and Montenegro", "SCG", 2006, "SRB MNE XKX"),
    ("Czechoslovakia", "CSK", 1993, "CZE SVK"),
    ("East Germany", "DDR", 1990, "DEU"),
    ("Netherlands Antilles", "ANT", 2010, "CUW SXM BES"),
    ("North Yemen", "YEM", 1990, "YEM"),
    ("South Yemen", "YMD", 1990, "YEM"),
    ("Sudan (former)", "SDN", 2011, "SDN SSD"),
    ("United Arab Republic", None, 1961, "EGY SYR"),
    ("Tanganyika", None, 1964, "TZA"),
    ("Zanzibar", None, 1964, "TZA"),
    ("North Vietnam", "VDR", 1976, "VNM"),
    ("South Vietnam", "VNM", 1976, "VNM"),
]

# Lower-case, single-spaced spellings of each entity.
ALIASES = {
    "Soviet Union": ["ussr", "u.s.s.r.", "soviet union", "the soviet union", "union of soviet socialist republics"],
    "Yugoslavia": ["yugoslavia", "sfr yugoslavia", "sfry", "socialist federal republic of yugoslavia"],
    "Serbia and Montenegro": ["serbia and montenegro", "fr yugoslavia", "federal republic of yugoslavia"],
    "Czechoslovakia": ["czechoslovakia", "czecho-slovakia"],
    "East Germany": ["east germany", "german democratic republic", "gdr"],
    "Netherlands Antilles": ["netherlands antilles"],
    "North Yemen": ["north yemen", "yemen arab republic"],
    "South Yemen": ["south yemen", "people's democratic republic of yemen", "democratic yemen"],
    "Sudan (former)": ["sudan (former)", "sudan (pre-2011)", "former sudan"],
    "United Arab Republic": ["united arab republic"],
    "Tanganyika": ["tanganyika"],
    "Zanzibar": ["zanzibar"],
    "North Vietnam": ["north vietnam", "democratic republic of vietnam"],
    "South Vietnam": ["south vietnam", "republic of vietnam"],
}


def historical_key(x):
    """Alias key of a name column: trimmed, single-spaced, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " "))


def historical_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, e) for e, names in ALIASES.items() for a in names], "alias string, historical string")


def historical_codes(spark: SparkSession) -> DataFrame:
    """(historical, iso3c_hist, dissolved, iso3c, country), a row per successor."""
    rows = [(e, code, year, s) for e, code, year, after in ENTITIES for s in after.split()]
    df = spark.createDataFrame(rows, "historical string, iso3c_hist string, dissolved int, iso3c string")
    return df.join(F.broadcast(crosswalk(spark).select("iso3c", "country")), "iso3c", "left").select("historical", "iso3c_hist", "dissolved", "iso3c", "country")
