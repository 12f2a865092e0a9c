"""Extension: panel columns on a stream.

Lag, growth and index go by years in order, but rows arrive in any order. Each
country's years are summed in state until the watermark passes their end; then
they leave in order, with what the years before them left behind.
"""

from __future__ import annotations

import calendar
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from ..errors import need_columns

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Sets the state store that timers and maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def year_end(year: int) -> int:
    """The first millisecond after a year."""
    return calendar.timegm((int(year) + 1, 1, 1, 0, 0, 0)) * 1000


class PanelYears(StatefulProcessor):
    """State of a country: open years' sums, the last year told, the base year's sum."""

    def __init__(self, value: str, base_year: int, to: float, forget_years: int):
        self.value, self.base_year, self.to, self.forget_years = value, base_year, to, forget_years

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "year int", "total double, known long")
        self.last = handle.getValueState("last", "year int, total double")
        self.base = handle.getValueState("base", "total double")

    def handleInputRows(self, key, rows, timerValues):
        told = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            pdf = pdf[pdf["year"].notna()]
            if told is not None:
                pdf = pdf[pdf["year"] > told]  # a year told stays as it was
            for year, own in pdf.groupby("year")[self.value]:
                year, known = int(year), own.dropna()
                total, n = self.open.getValue((year,)) if self.open.containsKey((year,)) else (0.0, 0)
                if not self.open.containsKey((year,)):
                    self.handle.registerTimer(year_end(year))
                self.open.updateValue((year,), (float(total) + math.fsum(known), int(n) + len(known)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted(int(k[0]) for k in self.open.keys() if year_end(k[0]) <= now)
        rows = []
        for year in ready:
            total, n = self.open.getValue((year,))
            v = float(total) if n else None
            before = None
            if self.last.exists():
                told, before = self.last.get()
                if year - told > self.forget_years:
                    before = None
                    self.base.clear()
            if year == self.base_year and v is not None:
                self.base.update((v,))
            base = self.base.get()[0] if self.base.exists() else None
            rows.append((key[0], year, v, before, v / before - 1 if v is not None and before else None, v / base * self.to if v is not None and base else None))
            self.last.update((year, v))
            self.open.removeKey((year,))
            self.handle.registerTimer(year_end(year + self.forget_years))
        # what is forgotten by then takes no room either
        if not ready and not any(True for _ in self.open.keys()) and self.last.exists() and now >= year_end(self.last.get()[0] + self.forget_years):
            self.last.clear()
            self.base.clear()
        if rows:
            names = ["iso3c", "year", self.value, f"{self.value}_lag", f"{self.value}_growth", f"{self.value}_index"]
            out = pd.DataFrame(rows, columns=names).astype({n: "float64" for n in names[2:]})
            yield out.astype({"year": "int32"})

    def close(self) -> None:
        pass


def panel_stream(stream: DataFrame, value: str, time_col: str, base_year: int, late: str = "30 days", to: float = 100.0, forget_years: int = 50) -> DataFrame:
    """(iso3c, year, value, lag, growth, index) of a stream of (iso3c, year, value, time).

    A year's values are summed, nulls and NaN left out; it is told when the
    watermark, `late` behind the latest time seen, passes its end. Later rows of
    it are dropped. Lag and growth are since the year told before, as in the
    batch operators; the index is null until the base year is told, and without
    one. A country without a year for forget_years starts anew. Rows without a
    year are dropped; a null code is a country of its own.
    """
    need_columns(stream, "iso3c", "year", value, time_col)
    keep_state_on_disk(stream.sparkSession)
    rows = stream.select("iso3c", "year", stream[value].cast("double").alias(value), time_col).withWatermark(time_col, late)
    schema = f"iso3c string, year int, `{value}` double, `{value}_lag` double, `{value}_growth` double, `{value}_index` double"
    return rows.groupBy("iso3c").transformWithStateInPandas(PanelYears(value, base_year, to, forget_years), schema, "Append", "EventTime")
