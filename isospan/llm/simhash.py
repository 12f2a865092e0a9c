"""SimHash near-duplicates, linked through Gray-order hierarchical indexes.

Fingerprints: one Arrow pass over whole texts, no shuffle. Linking works on the
distinct fingerprints only, so exact copies never meet again:

1. Pigeonhole: fingerprints within ``max_diff`` bits agree on one of
   ``max_diff + 1`` blocks of bits, so each goes to that many block groups; a
   group above ``split_rows`` is dealt again by a second cut of its other bits.
2. In a group, fingerprints are sorted by Gray rank and a tree is laid over
   them. A node holds the bits all its members share and its parent does not;
   differences accumulate downwards and a whole node is dropped once they pass
   ``max_diff``, or once it already lies in the query's component.
3. A group returns (member, root) links, at most one per member, never all
   pairs. Links of all groups are closed by alternating large-star and
   small-star rounds, each cut at a checkpoint.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_key, pieces_of
from .jaccard import BANDS
from .jaccard import LEAST as STAGE_LEAST
from .jaccard import SHINGLE as STAGE_SHINGLE
from .jaccard import banded, group_links, grouped, rest_links, text_nodes, text_sha, texts_of

SHINGLE = 4
SEED = 42
MAX_DIFF = 4
STAGE_MAX_DIFF = 7
GROUP_ROWS = 1000
SPLIT_ROWS = 20_000
FAN = 8
STAR_PART_ROWS = 50_000


# -- fingerprints -----------------------------------------------------------


def fingerprint_bytes(raw: bytes | None, k: int = SHINGLE) -> bytes:
    """Big-endian 8-byte SimHash of a UTF-8 text; zero when it has no word."""
    words = raw.lower().split() if raw else []
    if not words:
        return b"\0" * 8
    text = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_digest(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    n, ones, digest = len(first), np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, 1 << 18):
        part = b"".join([digest(text[a:b], SEED) for a, b in zip(first[at : at + (1 << 18)], last[at : at + (1 << 18)])])
        ones += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprint_batches(batches):
    import pyarrow as pa

    for batch in batches:
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.frombuffer(b"".join(map(fingerprint_bytes, raw)), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp BIGINT) per row. Null text counts as empty: fingerprint zero."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


# -- the Gray-order index ---------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Tree over fingerprints in Gray order; shared bits sit in the upper nodes."""

    def __init__(self, prints: np.ndarray, fan: int = FAN):
        self.fan = fan
        self.leaves = prints[np.argsort(gray_rank(prints), kind="stable")]
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        land, lor, levels = self.leaves, self.leaves, []
        while True:
            mask = ~(land ^ lor) & every
            levels.append((land & mask, mask))
            if len(land) <= 1:
                break
            cuts = np.arange(0, len(land), fan)
            land, lor = np.bitwise_and.reduceat(land, cuts), np.bitwise_or.reduceat(lor, cuts)
        self.levels = []
        for i, (pattern, mask) in enumerate(levels):
            own = mask if i + 1 == len(levels) else mask & ~np.repeat(levels[i + 1][1], fan)[: len(mask)]
            self.levels.append((pattern, own))

    def label_spans(self, label: np.ndarray):
        """Lowest and highest component label under each node, by level."""
        spans = [(label, label)]
        for pattern, _ in self.levels[1:]:
            cuts = np.arange(0, len(spans[-1][0]), self.fan)
            spans.append((np.minimum.reduceat(spans[-1][0], cuts), np.maximum.reduceat(spans[-1][1], cuts)))
        return spans

    def links(self, lo: int, hi: int, label: np.ndarray, max_diff: int):
        """Pairs (i, j), i in [lo, hi), j > i, within max_diff and not yet joined."""
        spans = self.label_spans(label)
        query = np.arange(lo, hi)
        node, acc = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int16)
        width = self.fan ** (len(self.levels) - 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, own = self.levels[depth]
            if depth + 1 < len(self.levels):
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                query, acc = np.repeat(query, self.fan), np.repeat(acc, self.fan)
                near = (node < len(pattern)) & ((node + 1) * width > query + 1)
                node, query, acc = node[near], query[near], acc[near]
            acc = acc + np.bitwise_count((self.leaves[query] ^ pattern[node]) & own[node])
            low, high = spans[depth]
            keep = (acc <= max_diff) & ~((low[node] == high[node]) & (low[node] == label[query]))
            node, query, acc = node[keep], query[keep], acc[keep]
            width //= self.fan
        return query, node


def local_roots(prints: np.ndarray, max_diff: int = MAX_DIFF) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, roots): the component of each within this set."""
    index = GrayIndex(prints)
    n = len(index.leaves)
    label = np.arange(n)
    step = int(max(16, min(1024, 4_000_000 // max(n, 1))))
    for lo in range(0, n, step):
        label = _joined(label, *index.links(lo, min(n, lo + step), label, max_diff))
    return index.leaves, index.leaves[label]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the least place of each component, after the places a are linked to b."""
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _block_links(max_diff: int):
    def links(pdf):
        import pandas as pd

        own, root = local_roots(np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64)), max_diff)
        moved = own != root
        return pd.DataFrame({"u": own[moved].view(np.int64), "v": root[moved].view(np.int64)})

    return links


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset from the right, width) of `parts` near-equal blocks of `bits` bits."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block(col, offset: int, width: int):
    return F.shiftrightunsigned(col, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _rotated(col, offset: int, width: int):
    """The other 64 - width bits, as the low bits, with the block taken out."""
    low = col.bitwiseAND(F.lit((1 << offset) - 1).cast("long")) if offset else F.lit(0).cast("long")
    top = F.shiftleft(F.shiftrightunsigned(col, offset + width), offset) if offset + width < 64 else F.lit(0).cast("long")
    return top.bitwiseOR(low)


def fingerprint_links(prints: DataFrame, n: int, max_diff: int = MAX_DIFF, group_rows: int = GROUP_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(u, v) links that span every group of fingerprints within max_diff bits.

    prints: distinct column fp; n: their count, which sets how fine blocks are cut.
    """
    blocks = _cuts(64, max_diff + 1)
    fp = F.col("fp")
    coarse = [max(0, w - max(0, int(np.ceil(np.log2(max(1, n / group_rows)))))) for _, w in blocks]
    keyed = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(_block(fp, o, w), c).alias("v")) for i, ((o, w), c) in enumerate(zip(blocks, coarse))])).alias("k"),
    ).select("fp", "k.b", "k.v")
    hot = keyed.groupBy("b", "v").count().where(F.col("count") > split_rows).select("b", "v", F.lit(True).alias("hot"))
    marked = keyed.join(hot, ["b", "v"], "left")
    plain = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("full"), F.lit(0).cast("long").alias("w")))

    def again(o: int, w: int):
        rest = _rotated(fp, o, w)
        return F.array(*[F.struct(F.lit(j).alias("j"), _block(fp, o, w).alias("full"), _block(rest, o2, w2).alias("w")) for j, (o2, w2) in enumerate(_cuts(64 - w, max_diff + 1))])

    finer = F.coalesce(*[F.when(F.col("b") == i, again(o, w)) for i, (o, w) in enumerate(blocks)])
    dealt = marked.select("b", "v", "fp", F.explode(F.when(F.col("hot"), finer).otherwise(plain)).alias("s")).select("b", "v", "s.*", "fp")
    return dealt.groupBy("b", "v", "j", "full", "w").applyInPandas(_block_links(max_diff), "u long, v long").distinct()


# -- connected components ---------------------------------------------------


def star_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' components as stars: every node that is not the least of its own, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = _joined(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _star_batches(batches):
    import pyarrow as pa

    u, v, parts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def joined():
        return star_links(*(np.concatenate(x) for x in zip((u, v), *parts)))

    for batch in batches:
        parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held += batch.num_rows
        if held > max(STAR_PART_ROWS, len(u)):
            (u, v), parts, held = joined(), [], 0
    u, v = joined()
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def star_components(links: DataFrame, parts: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for every u above it.

    A partition's links are closed to stars in its task. Partitions meet in
    alternating large-star and small-star rounds; each round is an aggregate and
    an equi-join, cut at a checkpoint (in at most `parts` files), and stops when
    the links stand still. Links of one partition need no round: each has some
    ten exchanges, for which the driver holds plans and threads.
    """
    def hold(df):
        return cut((df.coalesce(parts) if parts else df).mapInArrow(_star_batches, "u long, v long"))

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def with_least(df, total):
        # a hub's links are not dealt by the hub
        least = df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_rows"))
        return join_by_key(df, least, "u", total)

    now = hold(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if parts == 1:
        return now
    seen = state(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = with_least(large, 2 * seen[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = hold(small)
        then, seen = seen, state(now)
        if then == seen:
            return now
    raise RuntimeError("components did not settle")


# -- operators --------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = MAX_DIFF) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at max_diff or fewer differing bits; component_id is the
    smallest reachable doc_id. Null or wordless text has fingerprint zero and is
    linked like any other. Repeated rows and ids give one row each. A null
    doc_id keeps its row and is never a component_id (null if a component has
    no other). An empty table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_rows")))
    n, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    stars = star_components(fingerprint_links(nodes.select("fp"), n, max_diff), pieces_of(n, STAR_PART_ROWS))
    rooted = nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.col("_rows").alias("docs"), F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_rows"))
    named = cut(join_by_key(rooted, least, "root", n).select("fp", "component_id", F.col("docs").alias("_rows")))
    return join_by_key(prints, named, "fp", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def print_groups(nodes: DataFrame, n: int, max_diff: int = STAGE_MAX_DIFF) -> DataFrame:
    """(group, node): the component of each node's fingerprint, found through the Gray-order index."""
    prints = cut(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("_rows")))
    total = prints.count()
    stars = star_components(fingerprint_links(prints.select("fp"), total, max_diff), pieces_of(total, STAR_PART_ROWS))
    rooted = cut(prints.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("group"), "_rows"))
    return join_by_key(nodes.select("fp", "node"), rooted, "fp", n).select("group", "node")


def near_links(docs: DataFrame, rows: DataFrame, k: int = STAGE_SHINGLE, least: float = STAGE_LEAST, max_diff: int = STAGE_MAX_DIFF) -> DataFrame:
    """(u, v) node links that join every two texts of similarity least or more; rows: text_nodes of docs.

    SimHash proposes: the nodes of a component of fingerprints are compared by
    their whole sets. Like texts whose fingerprints differ by more bits are found
    by jaccard.rest_links, among nodes that are not joined yet.
    """
    nodes = cut(rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.min("sha").alias("sha")))
    n = nodes.count()
    near = grouped(print_groups(nodes, n, max_diff), n)
    bands = grouped(banded(nodes), BANDS * n)
    texts = texts_of(docs, nodes, near.select("node").union(bands.select("node")))
    found = group_links(near, texts, k, least)
    labels = star_components(found, pieces_of(n, STAR_PART_ROWS)).select(F.col("u").alias("node"), F.col("v").alias("label"))
    return found.union(rest_links(bands, texts, labels, k, least)).distinct()


def keep_one(docs: DataFrame, k: int = STAGE_SHINGLE, least: float = STAGE_LEAST) -> DataFrame:
    """docs without near-duplicates: one row of each component stays.

    Texts link where their k-word shingle sets have a Jaccard similarity of
    least or more (all such pairs: see near_links). The row with the smallest
    doc_id stays, of its rows the longest text, then the least SHA-256. Rows
    without a doc_id rank last. Rows of one doc_id in different components are
    no near-duplicates and all stay.
    """
    rows = cut(text_nodes(docs, k))
    stars = star_components(near_links(docs, rows, k, least), pieces_of(rows.select("node").distinct().count(), STAR_PART_ROWS))
    often = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.count()
    rooted = join_by_key(rows.drop("bands", "fp"), often.join(stars.withColumnRenamed("u", "node"), "node", "left"), "node", total)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (-F.col("size")).alias("size"), "sha"))
    kept = rooted.groupBy(F.coalesce("v", "node").alias("root")).agg(first.alias("k")).select(F.col("k.none").alias("_none"), F.coalesce("k.doc_id", F.lit(0)).alias("_id"), F.col("k.sha").alias("_sha"))
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select("*", id_.isNull().alias("_none"), F.coalesce(id_, F.lit(0)).alias("_id"), text_sha().alias("_sha"))
    order = Window.partitionBy("_none", "_id", "_sha").orderBy(F.lit(0))  # rows repeated in full
    chosen = keyed.join(kept, ["_none", "_id", "_sha"], "left_semi").withColumn("_n", F.row_number().over(order))
    return chosen.where("_n = 1").select(*docs.columns)
