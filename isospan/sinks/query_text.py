"""Chart queries as text."""

from __future__ import annotations

from ..errors import one_of


class ChartQuery(str):
    """A chart query; prints as its text."""

    def sql(self) -> str:
        return str(self)


def world_query(fill: str, source: str = "world", projection: str | None = None, palette: str | None = None, transform: str | None = None, title: str | None = None, draw: str = "spatial") -> ChartQuery:
    """VISUALISE .. AS fill FROM .. DRAW .., with optional projection, scale and label.

    A transform only counts along with a palette. Quotes in the title are doubled.
    """
    one_of("draw", draw, ("spatial", "point", "line", "polygon", "tile"))
    lines = [f"VISUALISE {fill} AS fill", f"FROM {source}", f"DRAW {draw}"]
    if projection:
        lines.append(f"PROJECT TO {projection}")
    if palette:
        lines.append(f"SCALE fill TO {palette}" + (f" VIA {transform}" if transform else ""))
    if title is not None:
        lines.append("LABEL title => '" + title.replace("'", "''") + "'")
    return ChartQuery("\n".join(lines))
