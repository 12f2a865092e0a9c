"""Texts of like word shingles: whole sets confirm what groups propose.

Each distinct shingle set is a node. simhash.py proposes first, by fingerprints;
what these join has one label from then on. Like texts whose fingerprints are too
far apart meet by min-hash bands. A node goes to BANDS groups, each by ROWS
min-hashes of its set; two sets of similarity s share no group with probability
(1 - s**ROWS) ** BANDS, 1.2e-7 at 0.8. Groups of one label are left out, groups
of equal members, by two 64-bit sums of their hashes, count once. In a
group the whole sets are compared, those already linked no more, and a group
returns one link a member at most.

A group above PART_NODES is dealt over parts, each with a copy of the group's
least node, its hub. Members that are linked to the hub are one component already
and needn't meet. Others (all of a family of texts that share a template but are
less alike than LEAST) are grouped anew by prefixes: with the shingles of all
members of such groups in one order, the rarest first, two sets of similarity
LEAST or more share one of the first (1 - LEAST) * size + 1, exactly. What is
still neither linked to the hub of a large group by one such shingle meets every
part of that group, PART_NODES at a time. Inside a task candidates come from
prefixes too.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_key

SHINGLE = 5
LEAST = 0.8
ROWS, BANDS = 5, 40
PART_NODES = 500
FEW = 32  # sets of other components that are tried without a look at prefixes
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def shingle_set(raw: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's k-word shingles; a shorter text is one."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(words) - k + 1), xxhash.xxh3_64_digest
    spans = zip(starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist())
    return np.unique(np.frombuffer(b"".join([digest(text[a:b]) for a, b in spans]), ">u8").astype(np.uint64))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """The BANDS group keys of a set."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def print_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set, signed: a bit is 1 where it is set in over half the hashes; zero for none."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def similar(a: frozenset, b: frozenset, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def prefix_size(n: int, least: float) -> int:
    """How many of the first shingles of a set of n hold one of every like set's first ones."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def set_links(ids: list[int], sets: list[np.ndarray], least: float = LEAST, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """(id, id) links that join every two sets of similarity least or more; those of one label are joined already.

    A set is tried with one member of the largest component so far, then with the
    members of other components that share a prefix.
    """
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank, order = np.empty(len(often), np.int64), np.argsort(often, kind="stable")
    rank[order] = np.arange(len(often))
    single = int((often == 1).sum())  # ranks below are of shingles that no other set has
    ends = np.cumsum([len(x) for x in sets])[:-1]
    ranked = [np.sort(x) for x in np.split(rank[code.ravel()], ends)]
    whole = [frozenset(x.tolist()) for x in ranked]
    part, links, holders = np.unique(ids if labels is None else labels, return_inverse=True)[1].ravel(), [], {}

    def tried(i, j):
        if part[i] != part[j] and similar(whole[i], whole[j], least):
            links.append((ids[i], ids[j]))
            part[part == part[j]] = part[i]

    for i, own in enumerate(ranked):
        if i:
            tried(i, int(np.argmax(part[:i] == np.bincount(part[:i]).argmax())))
        prefix = [x for x in own[: prefix_size(len(own), least)].tolist() if x >= single]
        others = np.flatnonzero(part[:i] != part[i])
        if len(others) > FEW:
            others = sorted(set().union(*[holders[x] for x in prefix if x in holders]))
        for j in others:
            tried(i, j)
        for x in prefix:
            holders.setdefault(x, []).append(i)
    return links


def _node_batches(k):
    def nodes(batches):
        import pyarrow as pa

        for batch in batches:
            ids, bands, prints = [], [], []
            for raw in batch.column(3).cast(pa.binary()).to_pylist():
                hashes = shingle_set(raw, k)
                ids.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                bands.append(bands_of(hashes).tolist())
                prints.append(print_of(hashes))
            made = pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "sha", "size", "node", "bands", "fp"])

    return nodes


def text_nodes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, sha, size, node, bands, fp) of every row; texts of one set are one node."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_sha().alias("sha"), F.char_length(text).alias("size"), text.alias("text"))
    return rows.mapInArrow(_node_batches(k), "doc_id long, sha binary, size int, node long, bands array<long>, fp long")


def text_sha():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes in wanted; docs are read once for it."""
    wanted = nodes.select("node", "sha").join(wanted.select("node").distinct(), "node", "left_semi")
    texts = docs.select(text_sha().alias("sha"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = texts.groupBy("sha").agg(F.first("text").alias("text"))  # copies go before the shuffle
    return cut(texts.join(wanted, "sha").groupBy("node").agg(F.min("text").alias("text")))


def group_links(members: DataFrame, texts: DataFrame, k: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(u, v) links, each confirmed on whole sets, of members that fit a task or are like their group's hub."""
    return _dealt_links(members.withColumn("label", F.col("node")), texts, k, least).where("not apart").select("u", "v")


def rest_links(members: DataFrame, texts: DataFrame, labels: DataFrame, k: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(u, v) node links that, with the labels, join every two texts of similarity least or more.

    members: grouped nodes by bands; labels: (node, label) of nodes that are joined already.
    """
    members = _open(members, labels)
    first = _dealt_links(members, texts, k, least)
    apart = cut(first.where("apart").select(F.col("v").alias("group"), F.col("u").alias("node")).distinct())
    links = first.where("not apart").select("u", "v")
    if apart.isEmpty():
        return links.distinct()
    # the rest of large groups meets by prefixes
    pool = members.join(apart.select("group").distinct(), "group", "left_semi").select("node").distinct()
    prefixes = _prefixes(pool.join(texts, "node"), k, least)
    rest = apart.select("node").distinct()
    shared = prefixes.join(rest, "node", "left_semi").select("group").distinct()
    near = cut(prefixes.join(shared, "group", "left_semi"))
    members = _open(grouped(near, near.count()), labels)
    second = _dealt_links(members, texts, k, least)
    # the rest of large groups by a shingle: each against every part, in blocks
    apart = second.where("apart").select(F.col("v").alias("group"), F.col("u").alias("node")).distinct().join(rest, "node", "left_semi")
    n_apart = apart.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / PART_NODES).cast("int").alias("blocks"))
    large = members.join(texts, "node").where("parts > 1").join(n_apart, "group")
    columns = ["group", "parts", "hub", "node", "label", "text"]
    block = F.pmod(F.xxhash64(F.lit(1), "node"), "blocks").cast("int").alias("block")
    asked = large.join(apart, ["group", "node"], "left_semi").select(*columns, block, _all_parts())
    every = large.select(*columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), _own_part())
    again = asked.unionByName(every).withColumn("parts", F.lit(1)).groupBy("group", "part", "block").applyInPandas(_compared(k, least), _LINK)
    return links.union(second.where("not apart").select("u", "v")).union(again.select("u", "v")).distinct()


_LINK = "u long, v long, apart boolean"


def _own_part():
    return F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")


def _all_parts():
    return F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with their labels, their own node where they have none; without the groups of one label."""
    named = cut(members.join(labels, "node", "left").select("group", "parts", "hub", "node", F.coalesce("label", "node").alias("label")))
    spans = named.groupBy("group").agg(F.count(F.lit(1)).alias("_rows"), F.min("label").alias("low"), F.max("label").alias("high"))
    return cut(join_by_key(named, spans.where("low < high").select("group", "_rows"), "group", named.count()))


def banded(nodes: DataFrame) -> DataFrame:
    """(group, node) of every band of every node."""
    return nodes.select(F.explode("bands").alias("group"), "node")


def grouped(keyed: DataFrame, n_rows: int) -> DataFrame:
    """(group, parts, hub, node) of rows (group, node): groups of several nodes, of equal ones the first."""
    count = F.count(F.lit(1))
    groups = keyed.groupBy("group").agg(count.alias("_rows"), F.min("node").alias("hub"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("_rows > 1")
    groups = cut(groups.groupBy("_rows", "hub", "x", "y").agg(F.min("group").alias("group")))
    parts = F.ceil(F.col("_rows") / PART_NODES).cast("int").alias("parts")
    return cut(join_by_key(keyed, groups.select("group", "hub", parts, "_rows"), "group", n_rows).select("group", "parts", "hub", "node"))


def _dealt_links(members: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Links of groups in parts with a hub each; apart: (node, group) that no part links to the hub."""
    # texts join before rows are dealt over parts and blocks, so that no node's copies meet in a task
    held, columns = members.join(texts, "node"), ["group", "parts", "hub", "node", "label", "text"]
    dealt = held.select(*columns, _own_part()).unionByName(held.where("parts > 1 and node = hub").select(*columns, _all_parts()))
    return cut(dealt.groupBy("group", "part").applyInPandas(_compared(k, least), _LINK))


def _compared(k: int, least: float):
    def compared(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("node").sort_values("node")
        ids, hub = pdf["node"].tolist(), pdf["hub"].iloc[0]
        labels = pdf["label"].tolist()
        found = set_links(ids, [shingle_set(raw, k) for raw in pdf["text"]], least, labels)
        out = [(u, v, False) for u, v in found]
        if pdf["parts"].iloc[0] > 1:  # who is not linked to the hub, directly or through others
            root = {i: i for i in ids}

            def top(i):
                while root[i] != i:
                    i = root[i]
                return i

            for u, v in [*found, *zip(ids, map(dict(zip(labels, ids)).get, labels))]:
                root[top(u)] = top(v)
            out += [(i, pdf["group"].iloc[0], True) for i in ids if top(i) != top(hub)]
        return pd.DataFrame(out, columns=["u", "v", "apart"])

    return compared


def _prefixes(held: DataFrame, k: int, least: float) -> DataFrame:
    """(group, node): the shingles of each text's prefix that other texts of held have as well."""

    def shingled(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(raw, k).view(np.int64) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "all"])

    sets = cut(held.select("node", "text").mapInArrow(shingled, "node long, all array<long>"))
    single = sets.select("node", F.size("all").alias("n"), F.explode("all").alias("group"))
    often = single.groupBy("group").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    total = sets.agg(F.coalesce(F.sum(F.size("all")), F.lit(0))).first()[0]
    shared = join_by_key(single, often.withColumn("often", F.col("_rows")), "group", total)
    size = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    rarest = F.sort_array(F.collect_list(F.struct("often", "group"))).alias("rarest")  # a text's own shingles
    ranked = shared.groupBy("node", "n").agg(rarest).withColumn("left", (size - (F.col("n") - F.size("rarest"))).cast("int"))
    return ranked.where("left > 0").select(F.explode(F.slice("rarest", 1, F.col("left"))).alias("r"), "node").select("r.group", "node")
