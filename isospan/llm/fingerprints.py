"""Document fingerprints: bottom-k sketches of shingle hashes, JVM-side only.

A sketch is the ascending array of the k smallest distinct XXH64 values of a
text's word shingles. Sketches of parts merge into the sketch of the whole
(`merge`), and two sketches estimate resemblance, containment and the number of
distinct shingles. Everything is a Column expression: no Python in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, shuffle_partitions, text_bytes

SHINGLE = 5
K = 256
BUCKET_BYTES = 128_000_000  # of text in a range of ids
MOST_BUCKETS = 16_384  # more bytes than these hold make longer ranges
_SPAN = float(2**64)


def words(text: Column) -> Column:
    """Lower-cased words of a text; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def shingle_hashes(word_list: Column, k: int = SHINGLE) -> Column:
    """XXH64 of every k-word shingle; a shorter text is one shingle, none if empty.

    word_list must be a column already materialised by an earlier projection.
    """
    n = F.size(word_list)
    full = F.transform(
        F.slice(word_list, 1, F.greatest(n - (k - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(word_list, i + j) for j in range(1, k)]),
    )
    short = F.array(F.xxhash64(F.array_join(word_list, " ")))
    return F.when(n >= k, full).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what a and b sketch."""
    return bottom_k(F.concat(a, b), k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated count of distinct shingles; exact while the sketch is not full."""
    kth = (F.element_at(sketch, -1).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: 1 for two empty sketches, 0 if one is empty."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(union, a), b)).cast("double")
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(union), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too (1 if a is empty)."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def encode(sketch: Column) -> Column:
    """A sketch as text: comma-joined hexadecimal hashes, '' when empty."""
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), ",")


def sketch_text(df: DataFrame, text_col: str, out: str, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """df with column `out`, the sketch of text_col (null text: empty sketch)."""
    held = f"_words_{out}"
    with_words = df.withColumn(held, words(F.col(text_col)))
    return with_words.withColumn(out, bottom_k(shingle_hashes(F.col(held), shingle), k)).drop(held)


def _range_bounds(docs: DataFrame, id_col: str, buckets: int):
    """(bounds, least id, whether an id is null): ids that start each later range.

    Bounds are actual ids, as many as there are buckets at most, so what comes
    to the driver is bounded by the bucket count whatever the input size.
    """
    row = docs.agg(
        F.percentile_approx(id_col, [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets).alias("b"),
        F.min(id_col).alias("least"),
        F.max(F.col(id_col).isNull()).alias("nulls"),
    ).first()
    return sorted({b for b in row["b"] or [] if b > row["least"]}), row["least"], bool(row["nulls"])


def with_next(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text, bucket, guest) in range buckets ordered by id.

    Each bucket also gets, as guest rows, the rows of the id that opens the next
    one, so that the follower of its last document is at hand; the last bucket
    gets those of the first id. One shuffle of the text; no single-task sort.
    Drop the guests after the last window over the same buckets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds, least, nulls = _range_bounds(rows, "doc_id", buckets)
    last = len(bounds)
    rows = rows.crossJoin(F.broadcast(docs.sparkSession.createDataFrame([(bounds,)], "bounds array<bigint>")))
    sought = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    halves = [1 << i for i in range(last.bit_length() - 1, -1, -1)]
    # binary search for how many bounds are not above the id
    step = lambda at, h: at + F.when(F.get("bounds", at + h - 1) <= sought, h).otherwise(F.lit(0))
    own = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step) if halves else F.lit(0)
    rows = rows.select("doc_id", "text", own.alias("own"), F.coalesce(F.get("bounds", own - 1) == sought, F.lit(False)).alias("opens")) if halves else rows.select("doc_id", "text", own.alias("own"), F.lit(False).alias("opens"))
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    at = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    mine = F.col("own")
    places = F.when(first, F.array(at(mine, 0), at(F.lit(last), 1))).when(F.col("opens"), F.array(at(mine, 0), at(mine - 1, 1))).otherwise(F.array(at(mine, 0)))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.bucket", "p.guest", "doc_id", "text")
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")


def edited(text: Column, follower: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of follower."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(follower, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, buckets: int | None = None, shingle: int = SHINGLE, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's start.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_shingles (estimated distinct shingles).

    Null text is empty: no shingle, empty fingerprint; two empty ones are alike
    (1), an empty and another one are not (0). A text of fewer than five words
    is one shingle. Documents follow each other by ascending doc_id, nulls
    first, rows repeating an id by text; the last is followed by the first. A
    lone document follows itself. An empty table gives no rows; other columns
    of the table are ignored.
    """
    if buckets is None:
        buckets = min(MOST_BUCKETS, pieces_of(text_bytes(docs, text_col)[1], BUCKET_BYTES, 4 * shuffle_partitions(docs.sparkSession)))
    rows = with_next(docs, buckets, id_col, text_col)
    rows = sketch_text(rows, "text", "sketch", shingle, k)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(_order())).where("guest = 0")
    rows = rows.withColumn("edit", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    rows = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "sketch", "next_sketch", "edit"
    )
    rows = sketch_text(rows, "edit", "edit_sketch", shingle, k)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edit_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edit_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )
