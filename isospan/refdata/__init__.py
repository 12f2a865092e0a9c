"""Reference tables: crosswalk, overrides, groups, historical entities, indicators."""

from .crosswalk import country_codes, crosswalk, dictionary
from .groups import GROUPS, country_groups, members
from .historical import historical_aliases, historical_codes
from .indicators import common_indicators, indicator_search
from .overrides import country_overrides

__all__ = ["GROUPS", "common_indicators", "country_codes", "country_groups", "country_overrides", "crosswalk", "dictionary", "historical_aliases", "historical_codes", "indicator_search", "members"]
