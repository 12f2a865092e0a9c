"""Common development indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import one_of

# Short name, catalogue code, description.
INDICATORS = [
    ("population", "SP.POP.TOTL", "Population, total"),
    ("gdp", "NY.GDP.MKTP.CD", "GDP (current US$)"),
    ("gdp_constant", "NY.GDP.MKTP.KD", "GDP (constant 2015 US$)"),
    ("gdp_per_capita", "NY.GDP.PCAP.KD", "GDP per capita (constant 2015 US$)"),
    ("gdp_per_capita_current", "NY.GDP.PCAP.CD", "GDP per capita (current US$)"),
    ("gni_per_capita", "NY.GNP.PCAP.CD", "GNI per capita (current US$)"),
    ("life_expectancy", "SP.DYN.LE00.IN", "Life expectancy at birth (years)"),
    ("fertility_rate", "SP.DYN.TFRT.IN", "Fertility rate (births per woman)"),
    ("infant_mortality", "SP.DYN.IMRT.IN", "Infant mortality rate (per 1,000)"),
    ("co2_per_capita", "EN.GHG.CO2.PC.CE.AR5", "Carbon dioxide emissions per capita (t)"),
    ("co2_total", "EN.GHG.CO2.MT.CE.AR5", "Carbon dioxide emissions (Mt)"),
    ("internet_users", "IT.NET.USER.ZS", "Individuals using the Internet (% of pop.)"),
    ("urban_population", "SP.URB.TOTL.IN.ZS", "Urban population (% of total)"),
    ("poverty_rate", "SI.POV.DDAY", "Poverty headcount ratio at $2.15/day (%)"),
    ("gini", "SI.POV.GINI", "Gini index"),
    ("unemployment", "SL.UEM.TOTL.ZS", "Unemployment (% of labour force)"),
    ("school_enrollment", "SE.PRM.ENRR", "School enrollment, primary (% gross)"),
    ("health_expenditure", "SH.XPD.CHEX.GD.ZS", "Current health expenditure (% of GDP)"),
    ("electricity_access", "EG.ELC.ACCS.ZS", "Access to electricity (% of pop.)"),
    ("mobile_subscriptions", "IT.CEL.SETS.P2", "Mobile subscriptions (per 100 people)"),
]


def common_indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDICATORS, "name string, code string, description string")


def indicator_search(catalogue: DataFrame, pattern: str, field: str = "name") -> DataFrame:
    """(indicator, name) rows of a catalogue whose field matches, ignoring case."""
    one_of("field", field, ("name", "indicator"))
    return catalogue.select("indicator", "name").where(F.col(field).rlike(f"(?i){pattern}"))
