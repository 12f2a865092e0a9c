"""Country groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpineError
from .crosswalk import crosswalk

AS_OF = "2026-06-01"

# Members of each group, as ISO 3166 alpha-3 codes by country name.
GROUPS = {
    "EU": "AUT BEL BGR HRV CYP CZE DNK EST FIN FRA DEU GRC HUN IRL ITA LVA LTU LUX MLT NLD POL PRT ROU SVK SVN ESP SWE",
    "EuroZone": "AUT BEL HRV CYP EST FIN FRA DEU GRC IRL ITA LVA LTU LUX MLT NLD PRT SVK SVN ESP",
    "G7": "USA CAN GBR FRA DEU ITA JPN",
    "G20": "ARG AUS BRA CAN CHN FRA DEU IND IDN ITA JPN KOR MEX RUS SAU ZAF TUR GBR USA",
    "BRICS": "BRA RUS IND CHN ZAF",
    "ASEAN": "BRN KHM IDN LAO MYS MMR PHL SGP THA VNM",
    "EFTA": "ISL LIE NOR CHE",
    "OPEC": "DZA AGO COG GNQ GAB IRN IRQ KWT LBY NGA SAU ARE VEN",
    "NATO": "ALB BEL BGR CAN HRV CZE DNK EST FIN FRA DEU GRC HUN ISL ITA LVA LTU LUX MNE NLD MKD NOR POL PRT ROU SVK SVN ESP TUR GBR USA",
    "OECD": "AUS AUT BEL CAN CHL COL CRI CZE DNK EST FIN FRA DEU GRC HUN ISL IRL ISR ITA JPN KOR LVA LTU LUX MEX NLD NZL NOR POL PRT SVK SVN ESP SWE CHE TUR GBR USA",
    "Commonwealth": "ATG AUS BHS BGD BRB BLZ BWA BRN CMR CAN CYP DMA SWZ FJI GAB GHA GRD GUY IND JAM KEN KIR LSO MWI MYS MDV MLT MUS MOZ NAM NRU NZL NGA PAK PNG RWA KNA LCA VCT WSM SYC SLE SGP SLB ZAF LKA TZA TGO TON TTO TUV UGA GBR VUT ZMB",
    "Mercosur": "ARG BRA PRY URY BOL",
    "GCC": "BHR KWT OMN QAT SAU ARE",
    "Nordic": "DNK FIN ISL NOR SWE",
    "Visegrad": "CZE HUN POL SVK",
}


def members(group: str) -> list[str]:
    """Codes of a group; an unknown one is an error that lists those there are."""
    if group not in GROUPS:
        raise SpineError(f"unknown group {group!r}; there are {', '.join(GROUPS)}")
    return GROUPS[group].split()


def country_groups(spark: SparkSession, group: str | list | None = None) -> DataFrame:
    """(group, iso3c, country, as_of), all groups or those named."""
    wanted = list(GROUPS) if group is None else [group] if isinstance(group, str) else list(group)
    rows = [(g, code) for g in wanted for code in members(g)]
    names = crosswalk(spark).select("iso3c", "country")
    df = spark.createDataFrame(rows, "`group` string, iso3c string")
    return df.join(F.broadcast(names), "iso3c", "left").select("group", "iso3c", "country", F.lit(AS_OF).alias("as_of")).orderBy("group", "country")
