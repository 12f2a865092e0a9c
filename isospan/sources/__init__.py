"""Sources: indicator tables, geometry frames and assembled country data."""

from .geometry import polygon_frame, square_grid, world_geometry
from .indicators import IndicatorSource, fetch_indicators, register
from .world import country_classification, country_data, validate_years, world_data

__all__ = ["IndicatorSource", "country_classification", "country_data", "fetch_indicators", "polygon_frame", "register", "square_grid", "validate_years", "world_data", "world_geometry"]
