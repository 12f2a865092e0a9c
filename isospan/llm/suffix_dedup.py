"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

What is sought: every byte covered by a string of `length` bytes that also
starts in a document with a smaller id.

1. Anchors. Each window of `length` bytes is assigned its least 24-byte gram by
   hash; equal windows have equal anchors. A first round (see rounds.py) finds
   the anchors that occur in more than one document. This leaves out text that
   cannot repeat and loses nothing.
2. Runs of windows around a repeated anchor go, deduplicated within a group of
   documents, to the bucket of their anchor. An anchor repeated in very many
   groups has its windows dealt one by one over all buckets instead.
3. A bucket splits its distinct strings over shards and builds each shard's
   Burrows-Wheeler transform. The transforms are merged by interleave
   refinement: starting from the shards one after another, each pass stably
   re-deals the interleave by the symbol that precedes it, so after pass k all
   suffixes stand in order of their first k bytes, and a block starts where
   these differ. After `length` passes the blocks are the intervals with a
   common prefix of that many bytes. No suffixes are sorted again.
4. Each interval's smallest id decides which windows are removed; the answers
   go back to the groups, which cut their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import pieces_of, text_bytes
from .rounds import NOTE, ask, grouped, ids_of, mix64, shared_tags, tag_codes, tag_packets, tell

LENGTH = 50
GRAM = 24
BUCKET_BYTES = 12_000_000  # of input text for each bucket
HOT_GROUPS = 500
SHARD_BYTES = 500_000
MERGE_BYTES = 1_500_000  # of strings in one merge, or those of one anchor


# -- Burrows-Wheeler transforms of shards -------------------------------------


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a ring of symbols ordered by their first `depth` symbols, then place."""
    key, known = symbols.astype(np.int64), 1
    while known < 7:  # seven symbols of nine bits fit one key
        key = (key << 9) | np.roll(symbols, -known).astype(np.int64)
        known += 1
    order = np.argsort(key, kind="stable")
    while True:
        sorted_key = key[order]
        new = np.cumsum(np.concatenate(([False], sorted_key[1:] != sorted_key[:-1])))
        if known >= depth or new[-1] == len(symbols) - 1:
            return order
        rank = np.empty(len(symbols), np.int64)
        rank[order] = new
        key = rank * (int(new[-1]) + 1) + np.roll(rank, -known)
        order = np.argsort(key, kind="stable")
        known *= 2


def transform(strings: list[bytes], depth: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, order) of a shard: symbols are codes of bytes, each string ends in 0."""
    flat = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    symbols = np.zeros(len(flat) + len(strings), codes.dtype)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(strings)), sizes)] = codes[flat]
    order = suffix_order(symbols, depth)
    return symbols[order - 1], order  # the string is read as a ring


def byte_codes(strings: list[bytes]) -> np.ndarray:
    """Dense codes from 1 of the bytes that occur, one byte wide where they fit."""
    used = np.zeros(256, bool)
    used[np.frombuffer(b"".join(strings), np.uint8)] = True
    return np.cumsum(used).astype(np.uint8 if used.sum() < 256 else np.uint16)


def merge_transforms(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each merged suffix, bytes it shares with the one before, at most depth).

    Iterative interleave refinement over any number of shards. An entry is a
    place in the shards' transforms laid one after another. A pass deals the
    interleave by the symbols that its entries precede; within a shard, the
    suffix that begins with such a symbol is found by the shard's own last-first
    mapping. Where a block first starts in pass k + 1, k bytes are shared.
    """
    every = np.concatenate(bwts)
    total = len(every)
    first = np.empty(total, np.int32)
    at = 0
    for bwt in bwts:
        first[at + np.argsort(bwt, kind="stable")] = np.arange(at, at + len(bwt), dtype=np.int32)
        at += len(bwt)
    entry, block, start = np.arange(total, dtype=np.int32), np.zeros(total, np.int32), np.ones(total, bool)
    shared = np.full(total, depth, np.uint8)
    for done in range(depth):
        symbol = every[entry]
        dealt = np.argsort(symbol, kind="stable")
        symbol, block, entry = symbol[dealt], block[dealt], first[entry[dealt]]
        start[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        shared[start] = np.minimum(shared[start], done)
        block = np.cumsum(start, dtype=np.int32)
    return entry, shared


def repeated_intervals(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of every window of `length` bytes in strings.

    Windows are equal exactly if their interval is; found by merging shards.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    of = (np.cumsum(sizes) - sizes) // shard_bytes
    bwts, owners, offsets, codes = [], [], [], byte_codes(strings)
    for k in np.unique(of):
        own = np.flatnonzero(of == k)
        bwt, order = transform([strings[i] for i in own], length, codes)
        bwts.append(bwt)
        inside = np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        owners.append(np.repeat(own, sizes[own])[order])
        offsets.append(inside[order])
    entry, shared = merge_transforms(bwts, length)
    owner, offset, interval = np.concatenate(owners)[entry], np.concatenate(offsets)[entry], np.cumsum(shared < length)
    whole = offset + length <= sizes[owner] - 1
    return owner[whole], offset[whole], interval[whole]


# -- anchors and runs of a group ----------------------------------------------


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each place.

    Halves are doubled in 32 bits; the two of a gram, of 16 and of 8 bytes, make
    one hash. Equal hashes of other grams would only mean a comparison more.
    """
    h = (flat.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    for w in (1, 2, 4, 8):
        eight = h
        h = h[:-w] * np.uint32(0x85EBCA6B) + h[w:]
        h ^= h >> np.uint32(16)
    n = len(flat) - GRAM + 1
    out = (h[:n].astype(np.uint64) << np.uint64(32)) ^ (eight[16 : 16 + n].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


class Runs:
    """Runs of windows with one anchor, over the concatenated texts of a group."""

    def __init__(self, raws: list[bytes], length: int):
        self.flat = np.frombuffer(b"".join(raws), np.uint8)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        n = len(self.flat) - length + 1
        self.first = self.count = self.anchor = self.doc = np.zeros(0, np.int64)
        self.tag = np.zeros(0, np.uint64)
        if n <= 0:
            return
        grams = gram_hashes(self.flat)
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span, width = 1, length - GRAM + 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        anchor = (key[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = np.zeros(n + 1, np.int32)
        has = lengths >= length
        np.add.at(valid, self.starts[has], 1)
        np.add.at(valid, np.minimum(self.ends[has] - length + 1, n), -1)
        valid = np.cumsum(valid[:n]) > 0
        change = np.empty(n, bool)
        change[:1] = True
        change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(change & valid)
        stop = np.zeros(n + 1, bool)
        stop[1:] = True
        stop[1:-1] = change[1:] | ~valid[1:]
        ends = np.flatnonzero(stop[1:] & valid) + 1
        self.first, self.count, self.anchor = first, ends - first, anchor[first]
        self.tag = grams[self.anchor]
        self.doc = np.searchsorted(self.ends, first, side="right")


def window_runs(runs: Runs, codes: np.ndarray, length: int):
    """(first, count, tag, doc) of runs to compare; those of hot anchors one window each."""
    warm, hot = np.flatnonzero(codes == 1), np.flatnonzero(codes == 2)
    each = runs.count[hot]
    owner = np.repeat(hot, each)
    first = runs.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    tag = np.zeros(0, np.uint64)
    if len(first):  # a window's own hash: two grams at its ends and one between
        at = gram_hashes(runs.flat)
        mid = (length - GRAM) // 2
        tag = mix64(at[first] ^ mix64(at[first + mid] ^ mix64(at[first + length - GRAM])))
    return (
        np.concatenate((runs.first[warm], first)),
        np.concatenate((runs.count[warm], np.ones(len(first), np.int64))),
        np.concatenate((runs.tag[warm], tag)),
        np.concatenate((runs.doc[warm], runs.doc[owner])),
    )


_HEAD = np.dtype([("tag", "<u8"), ("least", "<i8"), ("size", "u1")])


def run_packets(runs: Runs, codes: np.ndarray, ids: np.ndarray, length: int, buckets: int):
    """Distinct run strings of a group as packets, and the run -> string map.

    A packet holds its strings' tags, smallest document ids and sizes, then
    their bytes. Strings are told apart by their bytes, never by a hash.
    """
    first, count, tag, doc = window_runs(runs, codes, length)
    size = count + length - 1
    text = runs.flat.tobytes()
    strings: dict[bytes, int] = {}
    where = np.fromiter((strings.setdefault(text[a : a + s], len(strings)) for a, s in zip(first.tolist(), size.tolist())), np.int64, len(first))
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, where, ids[doc])
    tags = np.zeros(len(strings), np.uint64)
    tags[where] = tag
    bucket = ((mix64(tags ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) if len(tags) else np.zeros(0, np.int64)
    every = list(strings)
    order = np.argsort(bucket, kind="stable")
    packets, slot = [], np.empty(len(every), np.int64)
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        head = np.empty(len(own), _HEAD)
        part = [every[i] for i in own]
        head["tag"], head["least"], head["size"] = tags[own], least[own], [len(s) for s in part]
        packets.append((int(bucket[own[0]]), zstandard.compress(np.uint32(len(own)).tobytes() + head.tobytes() + b"".join(part), 1)))
    slot[order] = np.arange(len(order))
    return packets, slot[where], first, count, doc, least[where]


def _merges(some: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Strings in merges of bounded size; those of one anchor stay together."""
    if not len(some):
        return []
    some = some[np.argsort(group[some], kind="stable")]
    opens = np.flatnonzero(np.diff(group[some], prepend=-1))
    upto = np.add.reduceat(sizes[some], opens).cumsum()
    cuts = np.flatnonzero(np.diff(upto // MERGE_BYTES, prepend=0)) + 1
    return np.split(some, opens[cuts[cuts < len(opens)]])


def removed_windows(packets: list[tuple[int, bytes]], length: int) -> list[tuple[int, bytes]]:
    """Per string sent, a bit for each window that starts in a document with a
    smaller id than the string's own smallest."""
    heads, strings = [], []
    for _, packed in packets:
        blob = zstandard.decompress(packed)
        n = int(np.frombuffer(blob[:4], "<u4")[0])
        head = np.frombuffer(blob[4 : 4 + n * _HEAD.itemsize], _HEAD)
        heads.append(head)
        at = 4 + n * _HEAD.itemsize
        for s in head["size"].tolist():
            strings.append(blob[at : at + s])
            at += s
    head = np.concatenate(heads)
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, of, head["least"])
    distinct = list(known)
    windows = np.array([len(s) - length + 1 for s in distinct], np.int64)
    # the smallest id of each window: the string's own, or its interval's
    begin = np.cumsum(windows) - windows
    smallest = np.repeat(least, windows)
    tags = np.zeros(len(distinct), np.uint64)
    tags[of] = head["tag"]
    _, group, sizes = np.unique(tags, return_inverse=True, return_counts=True)
    some = np.flatnonzero(sizes[group] > 1)  # an anchor with one string has nothing to merge
    for part in _merges(some, group, windows + length):
        own, offset, interval = repeated_intervals([distinct[i] for i in part], length)
        ids = least[part[own]]
        by = np.full(int(interval.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(by, interval, ids)
        smallest[begin[part[own]] + offset] = by[interval]
    # windows of a sent string in bits, against the sender's own smallest id
    count = windows[of]
    place = np.repeat(begin[of], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    bit = smallest[place] < np.repeat(head["least"], count)
    shift = (np.arange(len(bit)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint32)
    masks = np.add.reduceat(bit.astype(np.uint32) << shift, np.cumsum(count) - count).astype("<u4") if len(count) else np.zeros(0, "<u4")
    out, at = [], 0
    for (group_id, _), h in zip(packets, heads):
        out.append((group_id, masks[at : at + len(h)].tobytes()))
        at += len(h)
    return out


# -- the operator -------------------------------------------------------------


def _anchor_question(length, buckets):
    def question(pdf, _):
        runs = Runs(pdf["text"].tolist(), length)
        return tag_packets(runs.tag, ids_of(pdf)[runs.doc], buckets)[0]

    return question


def _runs_and_codes(pdf, answers, length, buckets):
    runs, ids = Runs(pdf["text"].tolist(), length), ids_of(pdf)
    packets, _, where = tag_packets(runs.tag, ids[runs.doc], buckets)
    return runs, ids, tag_codes(packets, answers, where)


def _run_question(length, buckets):
    def question(pdf, answers):
        runs, ids, codes = _runs_and_codes(pdf, answers, length, buckets)
        packets, *_ = run_packets(runs, codes, ids, length, buckets)
        return [*packets, (NOTE, codes.tobytes())] if len(codes) else []

    return question


def covered_bytes(runs: Runs, codes: np.ndarray, ids: np.ndarray, answers: dict, length: int, buckets: int) -> np.ndarray:
    """Whether each byte of a group's texts is removed."""
    packets, where, first, count, doc, least = run_packets(runs, codes, ids, length, buckets)
    delta = np.zeros(len(runs.flat) + 1, np.int32)
    if len(first):
        masks = np.concatenate([np.frombuffer(answers[b], "<u4") for b, _ in packets])[where]
        masks = np.where(ids[doc] > least, np.uint32(0xFFFFFFFF), masks)
        start = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        shift = (start - np.repeat(first, count)).astype(np.uint32)
        start = start[(np.repeat(masks, count) >> shift) & np.uint32(1) == 1]
        np.add.at(delta, start, 1)
        np.add.at(delta, start + length, -1)
    return np.cumsum(delta[:-1]) > 0


def _cut(length, buckets, with_text):
    def use(pdf, answers):
        import pandas as pd

        raws = pdf["text"].tolist()
        runs, ids = Runs(raws, length), ids_of(pdf)
        codes = np.frombuffer(answers.get(NOTE, b""), np.uint8)
        gone = covered_bytes(runs, codes, ids, answers, length, buckets)
        edge = np.diff(gone.astype(np.int8), prepend=0)
        edge[runs.starts[runs.starts < len(edge)]] = gone[runs.starts[runs.starts < len(gone)]]
        removed = np.concatenate(([0], np.cumsum(gone)))
        spans = np.concatenate(([0], np.cumsum(edge == 1)))
        n_removed = removed[runs.ends] - removed[runs.starts]
        n_spans = spans[runs.ends] - spans[runs.starts]
        kept = [raw if not n else runs.flat[a:b][~gone[a:b]].tobytes() for raw, n, a, b in zip(raws, n_removed.tolist(), runs.starts.tolist(), runs.ends.tolist())]
        out = {"doc_id": pdf["doc_id"], "n_bytes": runs.ends - runs.starts, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        if with_text:
            out["kept"] = kept
        return pd.DataFrame(out)

    return use


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """Cuts every byte covered by a string that also starts in a smaller doc_id.

    One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    with with_text the remaining bytes (kept, binary). Strings of `length` bytes
    are compared on the input, overlaps count, matches never cross documents.
    Null text is empty. Rows of one doc_id do not remove each other's bytes; a
    null doc_id ranks after all others. An empty table gives no rows; other
    columns are ignored. length must be from 32 to 55.
    """
    if not 32 <= length <= 55:
        raise ValueError("length must be from 32 to 55 bytes")
    _, total = text_bytes(docs, text_col)
    groups = grouped(docs, total, id_col, text_col)
    buckets = pieces_of(total, bucket_bytes)
    anchors = ask(groups, _anchor_question(length, buckets), lambda packets: shared_tags(packets, hot_groups), buckets, total)
    told = ask(groups, _run_question(length, buckets), lambda packets: removed_windows(packets, length), buckets, total, told=anchors)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return tell(groups, told, _cut(length, buckets, with_text), schema, total)

