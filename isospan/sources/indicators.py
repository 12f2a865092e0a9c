"""Indicator tables: one Parquet folder per code, read as a Spark data source.

Layout: <root>/<code>/ with iso3c, iso2c, country, year, value. The reader makes
one partition per code and pushes year and code filters into it; an indicator
that is missing or broken gives no rows and a warning, as a remote API would.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from ..errors import SpineError, SpineWarning
from ..functions.text import valid_name

SCHEMA = "code string, iso3c string, iso2c string, country string, year int, value double"


@dataclass
class _Code(InputPartition):
    code: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.codes = [c for c in options.get("codes", "").split(",") if c]
        self.first, self.last = int(options.get("start", -(2**31))), int(options.get("end", 2**31 - 1))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("year",):
                self.first = self.last = f.value
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("year",):
                self.first = max(self.first, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("year",):
                self.last = min(self.last, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("code",):
                self.codes = [c for c in self.codes if c == f.value]
            yield f  # kept above as well, for rows this reader lets through

    def partitions(self):
        return [_Code(c) for c in self.codes] or [_Code("")]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        if not partition.code:
            return
        uri = f"{self.root.rstrip('/')}/{partition.code}"
        if uri.startswith("file:/") and not uri.startswith("file:///"):
            uri = "file://" + uri[len("file:") :]
        store, folder = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        if store.get_file_info(folder).type == fs.FileType.NotFound:
            return
        year = pc.field("year")
        found = ds.dataset(folder, filesystem=store, format="parquet").scanner(columns=["iso3c", "iso2c", "country", "year", "value"], filter=(year >= self.first) & (year <= self.last))
        schema = pa.schema([("code", pa.string()), ("iso3c", pa.string()), ("iso2c", pa.string()), ("country", pa.string()), ("year", pa.int32()), ("value", pa.float64())])
        for batch in found.to_batches():
            columns = [batch.column(f.name).cast(f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([partition.code] * batch.num_rows, pa.string()), *columns], schema=schema)


class IndicatorSource(DataSource):
    """spark.read.format("indicators").option("codes", "A,B").load(root)."""

    @classmethod
    def name(cls):
        return "indicators"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndicatorSource)


def normalize_indicator(indicator) -> dict[str, str]:
    """{name: code} of a mapping, a code or a list of codes."""
    if isinstance(indicator, dict):
        return {k or valid_name(v): v for k, v in indicator.items()}
    codes = [indicator] if isinstance(indicator, str) else list(indicator)
    return {valid_name(c): c for c in codes}


def read_long(spark: SparkSession, root: str, codes: list[str]) -> DataFrame:
    """All codes under root as one table, by Spark's own Parquet reader."""
    found = None
    for code in codes:
        try:
            part = spark.read.parquet(f"{root}/{code}").select(F.lit(code).alias("code"), "iso3c", "iso2c", "country", F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"))
        except Exception as e:
            warnings.warn(f"indicator {code} left out: {str(e).splitlines()[0][:200]}", SpineWarning, stacklevel=3)
            continue
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def merge_indicators(long: DataFrame, names: dict[str, str]) -> DataFrame:
    """(iso2c, iso3c, country, year, <names>): one aggregate instead of a chain of full joins.

    Identity columns come from whichever indicator has them.
    """
    cols = [F.max(F.when(F.col("code") == c, F.col("value"))).alias(n) for n, c in names.items()]
    return long.where("iso3c is not null").groupBy("iso3c", "year").agg(F.max("iso2c").alias("iso2c"), F.max("country").alias("country"), *cols).select("iso2c", "iso3c", "country", "year", *names)


def fetch_indicators(spark: SparkSession, root: str, indicator, start: int, end: int, cache: str | None = None) -> DataFrame:
    """Indicators of a span of years, merged; with cache, kept as Parquet there."""
    names = normalize_indicator(indicator)
    if start > end:
        raise SpineError("start is after end")
    key = f"{cache}/{'-'.join([*names.values(), str(start), str(end)])}" if cache else None
    if key:
        try:
            return spark.read.parquet(key)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # anything but a table not cached yet
                raise
    out = merge_indicators(read_long(spark, root, list(names.values())).where(F.col("year").between(start, end)), names)
    if key:
        out.write.mode("overwrite").parquet(key)
        return spark.read.parquet(key)
    return out


def clear_cache(spark: SparkSession, cache: str | None = None) -> None:
    """Forgets cached tables; with a folder, deletes it."""
    spark.catalog.clearCache()
    if cache:
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
