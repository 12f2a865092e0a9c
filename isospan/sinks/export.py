"""Tables handed to other engines."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpineError, one_of
from ..operators.nesting import polygons


def polygon_wkb(parts: list) -> bytes:
    """Little-endian WKB MultiPolygon of polygons, each a list of [(lon, lat), ...]
    rings, the outline first; rings are closed as needed."""
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for rings in parts:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for ring in rings:
            pts = list(ring)
            if pts and pts[0] != pts[-1]:
                pts.append(pts[0])
            out.append(struct.pack("<I", len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts))
    return b"".join(out)


def wkb_frame(data: DataFrame, geometry_col: str = "geometry") -> DataFrame:
    """A polygon frame as a row per country with WKB; other tables unchanged.

    Rings within rings are holes; outlines turn left, holes right.
    """
    if not {"iso3c", "group", "order", "long", "lat"} <= set(data.columns):
        return data
    rest = [c for c in data.columns if c not in ("iso3c", "group", "order", "long", "lat")]
    shapes = polygons(data)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            made = [polygon_wkb([[[(p["lon"], p["lat"]) for p in ring] for ring in part] for part in parts]) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["iso3c", geometry_col])

    made = shapes.mapInArrow(encode, f"iso3c string, `{geometry_col}` binary")
    if not rest:
        return made
    return data.where("iso3c is not null").groupBy("iso3c").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest]).join(made, "iso3c")


def as_source(data: DataFrame, name: str = "world", format: str = "view", con=None, path: str | None = None, geometry_col: str = "geometry"):
    """Offers a table to a chart engine.

    view: a temporary view; parquet: written to path (returned); arrow: an Arrow
    table (brought to the driver); duckdb: a table in a DuckDB connection, read
    from a Parquet folder where path is given, else from Arrow.
    """
    one_of("format", format, ("view", "parquet", "arrow", "duckdb"))
    out = wkb_frame(data, geometry_col)
    if format == "view":
        out.createOrReplaceTempView(name)
        return name
    if format == "arrow":
        return out.toArrow()
    if path is not None:
        out.write.mode("overwrite").parquet(path)
    if format == "parquet":
        if path is None:
            raise SpineError("parquet needs a path")
        return path
    if con is None:
        raise SpineError("duckdb needs a connection")
    if path is not None:
        con.execute(f"CREATE OR REPLACE TABLE \"{name}\" AS SELECT * FROM read_parquet('{path}/*.parquet')")
    else:
        held = out.toArrow()
        con.register("_isospan_held", held)
        con.execute(f'CREATE OR REPLACE TABLE "{name}" AS SELECT * FROM _isospan_held')
        con.unregister("_isospan_held")
    return name
