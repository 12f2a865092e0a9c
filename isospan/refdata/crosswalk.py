"""The country crosswalk.

Codes, English and localized names and currencies come from the Java runtime's
own ISO 3166, ISO 4217 and CLDR data, numeric codes and the UN's regions from
the ICU library that Spark ships, so nothing is transcribed; what they lack is
listed here by region.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedScheme

# World Bank style regions, by alpha-3 code.
REGIONS = {
    "East Asia & Pacific": "ASM AUS BRN KHM CHN FJI PYF GUM HKG IDN JPN KIR KOR PRK LAO MAC MYS MHL FSM MNG MMR NRU NCL NZL MNP PLW PNG PHL WSM SGP SLB TWN THA TLS TON TUV VUT VNM COK NIU TKL WLF NFK PCN CXR CCK",
    "Europe & Central Asia": "ALB AND ARM AUT AZE BLR BEL BIH BGR HRV CYP CZE DNK EST FRO FIN FRA GEO DEU GIB GRC GRL HUN ISL IRL IMN ITA KAZ XKX KGZ LVA LIE LTU LUX MKD MDA MCO MNE NLD NOR POL PRT ROU RUS SMR SRB SVK SVN ESP SWE CHE TJK TUR TKM UKR GBR UZB VAT ALA GGY JEY SJM",
    "Latin America & Caribbean": "ATG ARG ABW BHS BRB BLZ BOL BRA VGB CYM CHL COL CRI CUB CUW DMA DOM ECU SLV GRD GTM GUY HTI HND JAM MEX NIC PAN PRY PER PRI SXM KNA LCA MAF VCT SUR TTO TCA URY VEN VIR AIA BES BLM FLK GUF GLP MTQ MSR",
    "Middle East & North Africa": "DZA BHR DJI EGY IRN IRQ ISR JOR KWT LBN LBY MLT MAR OMN QAT SAU SYR TUN ARE PSE YEM ESH",
    "North America": "BMU CAN USA SPM",
    "South Asia": "AFG BGD BTN IND MDV NPL PAK LKA IOT",
    "Sub-Saharan Africa": "AGO BEN BWA BFA BDI CPV CMR CAF TCD COM COD COG CIV GNQ ERI SWZ ETH GAB GMB GHA GIN GNB KEN LSO LBR MDG MWI MLI MRT MUS MOZ NAM NER NGA RWA STP SEN SYC SLE SOM ZAF SSD SDN TZA TGO UGA ZMB ZWE MYT REU SHN",
}
# Continents of codes whose region does not settle it.
_CONTINENT_OF_REGION = {"Latin America & Caribbean": "Americas", "North America": "Americas", "South Asia": "Asia", "Sub-Saharan Africa": "Africa"}
CONTINENTS = {
    "Africa": "DZA DJI EGY LBY MAR TUN ESH",
    "Asia": "BHR IRN IRQ ISR JOR KWT LBN OMN QAT SAU SYR ARE PSE YEM ARM AZE CYP GEO KAZ KGZ TJK TUR TKM UZB BRN KHM CHN HKG IDN JPN KOR PRK LAO MAC MYS MNG MMR PHL SGP TWN THA TLS VNM CXR CCK",
    "Europe": "MLT",
    "Americas": "GRL",
    "Oceania": "",
}
UN_REGIONS = {"002": "Africa", "019": "Americas", "142": "Asia", "150": "Europe", "009": "Oceania"}
NO_M49 = ("TWN", "XKX")  # the UN lists neither
LANDLOCKED = "AFG AND ARM AUT AZE BLR BTN BOL BWA BFA BDI CAF TCD CZE SWZ ETH HUN KAZ KGZ LAO LSO LIE LUX MWI MLI MDA MNG NPL NER MKD PRY RWA SMR SRB SVK SSD CHE TJK TKM UGA UZB VAT ZMB ZWE"
INCOME_LEVELS = ["Not classified", "Low income", "Lower middle income", "Upper middle income", "High income"]

# Spellings beyond the English name of a country.
ALIASES = {
    "USA": "us|u.s.|usa|u.s.a.|america|united states of america",
    "GBR": "uk|u.k.|great britain|britain|united kingdom of great britain and northern ireland|england|scotland|wales|northern ireland",
    "KOR": "korea|s. korea|korea, rep.|republic of korea|korea, republic of|korea (south)|korea, south",
    "PRK": "n. korea|korea, dem. people's rep.|democratic people's republic of korea|korea, dem. rep.|korea (north)|korea, north|dprk",
    "CZE": "czech republic|czechia",
    "RUS": "russian federation|ussr|soviet union",
    "CIV": "cote d'ivoire|ivory coast|côte d'ivoire",
    "COD": "congo, dem. rep.|democratic republic of the congo|dr congo|drc|zaire|congo (kinshasa)|congo, the democratic republic of the|congo, democratic republic of the|democratic republic congo|congo-kinshasa",
    "COG": "congo, rep.|republic of the congo|congo|congo (brazzaville)|republic of congo",
    "MMR": "myanmar|burma",
    "SWZ": "swaziland",
    "MKD": "macedonia|north macedonia, republic of|fyr macedonia|macedonia, fyr|former yugoslav republic of macedonia|fyrom",
    "CPV": "cabo verde|cape verde",
    "TUR": "turkey|turkiye|türkiye",
    "VNM": "viet nam",
    "LAO": "lao pdr|lao people's democratic republic",
    "IRN": "iran, islamic rep.|islamic republic of iran|iran (islamic republic of)",
    "EGY": "egypt, arab rep.|arab republic of egypt",
    "VEN": "venezuela, rb|venezuela (bolivarian republic of)",
    "YEM": "yemen, rep.|republic of yemen",
    "GMB": "gambia, the|the gambia",
    "BHS": "bahamas, the|the bahamas",
    "HKG": "hong kong|hong kong sar, china",
    "MAC": "macau|macao|macao sar, china",
    "SVK": "slovak republic",
    "KGZ": "kyrgyz republic",
    "SYR": "syrian arab republic",
    "BRN": "brunei darussalam",
    "TZA": "united republic of tanzania|tanzania, united republic of",
    "BOL": "bolivia (plurinational state of)|plurinational state of bolivia",
    "MDA": "republic of moldova",
    "NLD": "holland|the netherlands",
    "PSE": "palestine|west bank and gaza|state of palestine|palestine, state of",
    "FSM": "micronesia (federated states of)",
    "TWN": "taiwan, china|chinese taipei|republic of china|taiwan, province of china|taiwan (republic of china)",
    "DEU": "federal republic of germany|west germany",
    "CHN": "people's republic of china|prc|mainland china",
    "VAT": "holy see|vatican",
    "KNA": "st. kitts and nevis",
    "LCA": "st. lucia",
    "VCT": "st. vincent and the grenadines|st. vin. and gren.",
    "STP": "sao tome and principe",
    "BIH": "bosnia",
    "ARE": "uae|u.a.e.",
    "TTO": "trinidad",
    "ATG": "antigua",
    "CAF": "car",
    "VIR": "us virgin islands|united states virgin islands",
    "VGB": "virgin islands (british)",
    "ZAF": "republic of south africa|rsa",
    "SSD": "republic of south sudan",
    "TLS": "east timor",
    "IRL": "republic of ireland",
    "MAF": "saint martin (french part)|st. martin (french part)",
    "SXM": "sint maarten (dutch part)",
    "CUW": "curaçao",
    "BLM": "saint barthélemy",
    "FRA": "french republic",
    "PRT": "portuguese republic",
    "ITA": "italian republic",
    "GRC": "hellenic republic",
    "ARG": "argentine republic",
    "GAB": "gabonese republic",
    "TGO": "togolese republic",
    "LBN": "lebanese republic",
    "CHE": "swiss confederation",
    "MEX": "united mexican states",
    "URY": "eastern republic of uruguay|oriental republic of uruguay",
    "DOM": "dominican republic",
    "GNQ": "equatorial guinea",
    "AUT": "republic of austria",
}
# Spellings that need a pattern: what is left after the aliases.
PATTERNS = {
    "USA": r"^united states( of america)?$",
    "KOR": r"^(?!.*north)(?!.*dem).*republic of korea",
    "RUS": r"russian fed",
    "CZE": r"^czech rep",
    "COD": r"dem(ocratic)?\.? rep(ublic)?\.? (of )?(the )?congo",
}

_FROM, _TO = "àáâãäåāăąçćčèéêëēėęìíîïīıñńòóôõöøōőùúûüūűýÿšśşžźżłğđðțţř’‘`´", "aaaaaaaaaccceeeeeeeiiiiiinnoooooooouuuuuuyyssszzzlgddttr''''"


# Abbreviations in country names, with or without a full stop; those of one letter need one.
SHORT = {"rep": "republic", "dem": "democratic", "fed": "federated", "isl": "islands", "is": "islands", "eq": "equatorial", "em": "emirates", "herz": "herzegovina", "st": "saint", "sts": "states", "terr": "territory"}
LETTERS = {"n": "north", "s": "south", "w": "western", "u": "united"}
# Words of official names: forms of state, and what may stand before these.
STATES = "republic|kingdom|state|states|sultanate|principality|grand duchy|commonwealth|union|federation|confederation|emirate"
KINDS = "federal|federative|federated|democratic|socialist|islamic|arab|bolivarian|plurinational|cooperative|co operative|united|independent|peoples|hashemite"
_OFFICIAL = rf"^(?:(?:(?:{KINDS}) )*(?:{STATES}) of (?:the )?)+(.+)$"
_INVERTED = rf"^(.+?) (?:(?:{KINDS}) )*(?:{STATES})(?: of(?: the)?)?$"

#: What makes a spelling a key, in order: (pattern, replacement).
_STEPS = [
    ("&", " and "),
    ("-", " "),
    (r"\s+", " "),
    *[(rf"\b{a}\. (?=[a-z])", f"{b} ") for a, b in LETTERS.items()],
    (r"[^a-z0-9 .]", ""),
    *[(rf"\b{a}\b\.?", b) for a, b in SHORT.items()],
    (r"\.", ""),
    (r"^ *the ", ""),
    (r" the *$", ""),
    (r" +", " "),
]


def normal(name: str) -> str:
    """Key of a spelling: no case, accents, punctuation, abbreviations or article."""
    s = name.lower().translate(str.maketrans(_FROM, _TO))
    for pattern, put in _STEPS:
        s = re.sub(pattern, put, s)
    return s.strip()


def normal_column(x):
    """normal() as a Column."""
    s = F.translate(F.lower(x), _FROM, _TO)
    for pattern, put in _STEPS:
        s = F.regexp_replace(s, pattern, put)
    return F.trim(s)


def short_column(key):
    """A key without its form of state (kingdom of spain, moldova republic of), null if it has none."""
    return F.coalesce(*[F.when(key.rlike(p), F.regexp_extract(key, p, 1)) for p in (_OFFICIAL, _INVERTED)])


def flag(iso2c: str) -> str:
    return "".join(chr(0x1F1E6 + ord(c) - ord("A")) for c in iso2c)


def _places() -> tuple[dict, dict]:
    region = {c: r for r, codes in REGIONS.items() for c in codes.split()}
    continent = {}
    for c, r in region.items():
        continent[c] = _CONTINENT_OF_REGION.get(r, {"Europe & Central Asia": "Europe", "East Asia & Pacific": "Oceania"}.get(r))
    continent |= {c: k for k, codes in CONTINENTS.items() for c in codes.split()}
    return region, continent


@lru_cache(maxsize=4)
def _rows(jvm_spark) -> tuple:
    jvm = jvm_spark._jvm
    locale, currency = jvm.java.util.Locale, jvm.java.util.Currency
    region, continent = _places()
    english, rows = locale.forLanguageTag("en"), []
    for iso2c in [*locale.getISOCountries(), "XK"]:
        own = locale.forLanguageTag(f"und-{iso2c}")
        iso3c = "XKX" if iso2c == "XK" else own.getISO3Country()
        money = None
        if iso2c != "XK":
            held = currency.getInstance(own)
            money = held.getCurrencyCode() if held is not None else None
        tld = ".uk" if iso2c == "GB" else None if iso2c == "XK" else f".{iso2c.lower()}"
        name = own.getDisplayCountry(english)
        number, un_region, part = _m49(jvm, iso2c)
        known = iso3c not in NO_M49
        rows.append((iso3c, iso2c, name, continent.get(iso3c), region.get(iso3c), un_region if known else None, money, tld, flag(iso2c), iso3c in LANDLOCKED.split(), number if iso3c != "XKX" else None, number if known else None, part))
    return tuple(rows)


def _m49(jvm, iso2c: str) -> tuple:
    """(numeric code, region, subregion) of the UN's standard country or area codes."""
    regions = jvm.com.ibm.icu.util.Region
    try:
        own = regions.getInstance(iso2c)
    except Exception:  # a code that ICU does not list
        return None, None, None
    above = [own.getContainingRegion(kind) for kind in (regions.RegionType.CONTINENT, regions.RegionType.SUBCONTINENT)]
    region, part = (a.toString() if a is not None else None for a in above)
    english = jvm.java.util.Locale.forLanguageTag("en")
    name = jvm.java.util.Locale.forLanguageTag(f"und-{part}").getDisplayCountry(english) if part and part.isdigit() else None
    return own.getNumericCode(), UN_REGIONS.get(region) if name else None, name


SCHEMA = "iso3c string, iso2c string, country string, continent string, region string, un_region string, currency string, tld string, flag string, landlocked boolean, iso3n int, un int, region23 string"
#: Destination names of a scheme.
SCHEMES = {n: n for n in ("iso3c", "iso2c", "country", "continent", "region", "un_region", "flag", "currency", "tld", "landlocked", "iso3n", "un", "region23")}
SCHEMES |= {"country.name": "country", "name": "country", "country.name.en": "country", "un.region.name": "un_region", "unicode.symbol": "flag", "iso4217c": "currency", "cctld": "tld", "wb": "iso3c", "un.regionsub.name": "region23", "iso.name.en": "country"}


def scheme_column(name: str) -> str:
    if name not in SCHEMES:
        raise UnsupportedScheme(f"scheme {name!r} isn't in the crosswalk; it has {', '.join(SCHEMES)}")
    return SCHEMES[name]


def crosswalk(spark: SparkSession) -> DataFrame:
    """One row per country code, Kosovo's user-assigned XKX included (some 250 rows)."""
    return spark.createDataFrame(list(_rows(spark)), SCHEMA)


def rows(spark: SparkSession) -> tuple:
    return _rows(spark)


def localized_names(spark: SparkSession, language: str) -> DataFrame:
    """(iso3c, name): names in a language, from the runtime's CLDR tables."""
    locale = spark._jvm.java.util.Locale
    to = locale.forLanguageTag(language.replace("_", "-"))
    return spark.createDataFrame([(r[0], locale.forLanguageTag(f"und-{r[1]}").getDisplayCountry(to)) for r in _rows(spark)], "iso3c string, name string")


def country_codes(spark: SparkSession, codes: list | None = None) -> DataFrame:
    """The crosswalk, or its country, iso3c and the named columns; unknown names are left out."""
    df = crosswalk(spark).where("iso3c is not null")
    if codes is None:
        return df
    wanted = [SCHEMES[c] for c in codes if c in SCHEMES]
    return df.select(*dict.fromkeys(["country", "iso3c", *wanted]))


def dictionary(spark: SparkSession) -> dict[str, str]:
    """Normalised spelling -> iso3c, of English names and aliases; ambiguous ones are left out."""
    found: dict[str, set] = {}
    for r in _rows(spark):
        for name in {r[2], re.sub(r"\s*\(.*\)$", "", r[2])}:
            found.setdefault(normal(name), set()).add(r[0])
    for code, names in ALIASES.items():
        for name in names.split("|"):
            found[normal(name)] = {code}
    return {k: next(iter(v)) for k, v in found.items() if len(v) == 1 and k}
