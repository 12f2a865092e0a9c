"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage (spark.checkpoint.dir).

    Only where a local session names none (tests) a temporary folder is set; on
    a cluster its absence is an error, as a folder of the driver's own is not
    seen by the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="isospan-"))
    return sc._jsc.sc().getCheckpointDir().get()


def open_store(uri: str):
    """(file system, path) of a folder that all executors share."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


HOT_ROWS = 200
HOT_KEYS = 50_000


def join_by_key(rows: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with small (a row per key), without a task for all rows of one key.

    small has a column _rows: how often rows has the key. total is the count of
    rows, or more. A key with over total / HOT_KEYS rows (HOT_ROWS at least) is
    broadcast; there are HOT_KEYS of these at most. The others meet by shuffle.
    how may be "left".
    """
    hot = F.col("_rows") > max(HOT_ROWS, total // HOT_KEYS)
    often = F.broadcast(small.where(hot).drop("_rows").withColumn("_hot", F.lit(True)))
    marked = rows.join(often, key, "left")
    done = marked.where("_hot").drop("_hot")
    rest = rows.join(F.broadcast(small.where(hot).select(key)), key, "left_anti").join(small.where(~hot).drop("_rows"), key, how)
    return done.unionByName(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes) of a text column: one aggregate, no shuffle of text."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.col(column)).cast("long")), F.lit(0)).alias("b"),
    ).first()
    return int(row["n"]), int(row["b"])


def pieces_of(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; ISOSPAN_TOKENIZERS names another folder."""
    folder = os.environ.get("ISOSPAN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
