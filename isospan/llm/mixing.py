"""Mixing sources to target weights, JVM-side only.

Every document gets a hash-random key. Within a source the keys' leading digits
cut it into even ranges, however large the source is; a range is sorted by key
for its running sum, and the sums of the ranges before it are added, so a
source's prefix sums are exact without one task ever holding a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
MOST = 3
RANGE_ROWS = 20_000
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Targets by weight over the whole of sizes, none above `most` times its size.

    Water filling: the excess of capped entries goes to the others by weight
    until none is above its cap.
    """
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= math.fsum(out[i] for i in over)
        capped = set(over)
        open_ = [i for i in open_ if i not in capped]
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        "*",
        F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit("-")).alias("_src"),
        word_count(F.col(text_col)).alias("_size"),
        F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit("")))).alias("_key"),
    )


def _plan(small: DataFrame, weights: tuple, most: int) -> DataFrame:
    """One row per source: its size, target, whole epochs and where the last ends.

    small: _src, _size, _key. Rows of one key are alike and share what the cut
    leaves them. Only rows per source reach the driver.
    """
    spark = small.sparkSession
    totals = small.groupBy("_src").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r["_src"] == "-", r["_src"]))
    sizes = [int(r["s"]) for r in totals]
    targets = share_out(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], most)
    schema = "_src string, source_size long, target double, whole long, rest long"
    budgets = [min(int(t), most * s) for t, s in zip(targets, sizes)]
    rows = [(r["_src"], s, t, b // s if s else 0, b % s if s else 0) for r, s, t, b in zip(totals, sizes, targets, budgets)]
    plan = spark.createDataFrame(rows, schema)
    digits = min(6, max(1, math.ceil(math.log(max(2, sum(r["n"] for r in totals) / RANGE_ROWS), 16))))
    ranged = small.select("_src", "_size", "_key", F.substring("_key", 1, digits).alias("_range"))
    sums = ranged.groupBy("_src", "_range").agg(F.sum("_size").alias("s"))
    before = sums.select("_src", "_range", "s", (F.sum("s").over(Window.partitionBy("_src").orderBy("_range")) - F.col("s")).alias("before"))
    cut_range = _with_plan(before, plan, len(rows)).where("before <= rest and rest < before + s").select("_src", "_range", F.col("rest") - F.col("before"))
    cut_range = cut_range.toDF("_src", "_range", "left_over")
    keys = ranged.join(F.broadcast(cut_range) if len(rows) <= BROADCAST_SOURCES else cut_range, ["_src", "_range"])
    keys = keys.groupBy("_src", "_range", "_key").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("c"), F.first("left_over").alias("left_over"))
    upto = F.sum("s").over(Window.partitionBy("_src", "_range").orderBy("_key")) - F.col("s")
    at = keys.withColumn("upto", upto).where("upto <= left_over and left_over < upto + s")
    cuts = {r["_src"]: (r["_key"], r["part"]) for r in at.select("_src", "_key", F.expr("(left_over - upto) div c").alias("part")).collect()}
    return spark.createDataFrame([r + cuts.get(r[0], (None, 0)) for r in rows], schema + ", cut_key string, part long")


def _with_plan(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    return rows.join(F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan, "_src")


def _taken():
    last = F.when(F.col("_key") < F.col("cut_key"), F.col("_size")).when(F.col("_key") == F.col("cut_key"), F.col("part")).otherwise(F.lit(0).cast("long"))
    return (F.col("whole") * F.col("_size") + last).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of each document.

    Columns: doc_id, size, source_size, target, taken, source. Sources are
    ordered by code point, null last, and weighted in turn. A source's budget is
    its target's whole part: whole epochs of all its documents first, then a
    last one by ascending key, cut inside the document at which the budget ends.
    Keys are digests of id and text, so reruns agree; rows alike in both share
    evenly what the cut leaves them. Null text has size 0 and is never taken; a
    null source is a source of its own. Source totals and cuts, one row per
    source, are all that is brought to the driver. An empty table gives no rows;
    other columns are ignored.
    """
    keyed = _keyed(docs.select(id_col, text_col, F.col(source_col).cast("string").alias(source_col)), id_col, text_col, source_col)
    small = cut(keyed.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), "_src", "_size", "_key"))
    plan = _plan(small, weights, most)
    return _with_plan(small, plan, plan.count()).select("doc_id", F.col("_size").alias("size"), "source_size", "target", _taken().alias("taken"), "source")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs as the mix takes them: a document repeats for each whole time it is
    taken, and once more with only its first words where a source's budget ends
    inside it. Documents without words, null texts among them, are kept once; a
    null source is a source of its own, null ids and repeated rows are documents
    like others, an empty table stays empty. Columns are docs' own; a source's
    documents are not shuffled, they only meet its row of the plan.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "text", "source")
    keyed = _keyed(row, "doc_id", "text", "source")
    plan = _plan(cut(keyed.select("_src", "_size", "_key")), weights, most)
    taken = _with_plan(keyed, plan, plan.count()).withColumn("_taken", _taken())
    times = F.when(F.col("_size") == 0, F.lit(1).cast("long")).otherwise(F.expr("_taken div _size"))
    part = F.when(F.col("_size") == 0, F.lit(0).cast("long")).otherwise(F.expr("_taken % _size"))
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), times.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = taken.withColumn("_cut", F.explode(copies))
    lead = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0)), F.lit(1), F.greatest(F.col("_cut"), F.lit(0)).cast("int")), "")
    out = rows.withColumn("_text", F.when(F.col("_cut") > 0, lead).otherwise(F.col("text")))
    shown = {"text": F.col("_text").alias("text")}
    if "n_chars" in names:
        shown["n_chars"] = F.when(F.col("_cut") > 0, F.char_length("_text").cast("long")).otherwise(F.col("_row.n_chars")).alias("n_chars")
    return out.select(*[shown.get(c, F.col("_row")[c].alias(c)) for c in names])
