"""Line deduplication by content-defined chunks of lines.

A text is split at line feeds. A chunk of lines ends where a rolling hash over
the hashes of the last ROLL lines has a local minimum, so boundaries depend on
the lines beside them only and move along with inserted or deleted ones; chunks
have LEAST_LINES lines or more, some three on average.

Where a repeated passage begins or ends inside a chunk, the chunk as a whole
doesn't repeat. So every part of several lines that adjoins a boundary is
looked at: the heads of a chunk (the whole chunk is the longest), its tails, and
the two lines on both sides of a boundary. A part that occurs more than once in
the corpus is kept in its first place (by doc_id, then line) and removed
elsewhere; a removed line always stays in an earlier place. Parts with less than
two lines that aren't blank are left out: a single repeated line is no passage.

A round of hashes (see rounds.py) finds the parts that repeat. Only these leave
their group of documents as bytes, once a group, for an aggregate by the bytes
themselves that keeps the least place of each; a part repeated in every
document is reduced in each map task before anything is shuffled. Only the group
of a first place is told, so that no answer is as frequent as a part: what
repeats and isn't told of goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, text_bytes
from .rounds import ask, beside, grouped, ids_of, ordered, shared_tags, tag_codes, tag_packets, tell

ROLL = 2
MOST_LINES = 16
LEAST_LINES = 2
BUCKET_BYTES = 60_000_000
FIRST = -2  # told beside the answers by bucket: which of a group's parts stand first
_ROLL_BASE = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(lines: list[bytes], roll: int = ROLL, most: int = MOST_LINES) -> list[int]:
    """Line numbers after which a chunk ends; the last line always ends one.

    A chunk ends after a line whose hash, rolled over the last `roll` lines, is
    below its neighbours' hashes, so no chunk is one line long and a boundary
    depends on nothing but the lines beside it. Only a text of one line is one
    such chunk. Only lines of falling or equal hashes, such as one line over and
    over, have no boundary: they are cut each `most` lines from the last one on.
    """
    n = len(lines)
    single = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, n)
    rolled = single.copy()
    for back in range(1, min(roll, n)):  # of back lines before, times the base's power
        with np.errstate(over="ignore"):
            rolled[back:] += single[:-back] * _ROLL_BASE**np.uint64(back)
    low = np.zeros(n + 1, bool)
    if n > 2:
        low[2:n] = (rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] <= rolled[2:])
    ends, last = [], 0
    for i in [*np.flatnonzero(low).tolist(), n]:
        while i - last > most and last + most <= n - LEAST_LINES:
            last += most
            ends.append(last)
        if i - last >= LEAST_LINES and i <= n - LEAST_LINES:
            ends.append(i)
            last = i
    return [*ends, n] if n else []


def multi_line_parts(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(first line, lines, first byte, end byte) of the parts of a text that adjoin
    a boundary and have two lines or more that aren't blank, by first line and length."""
    if b"\n" not in raw:
        return []
    lines = raw.split(b"\n")
    starts = np.cumsum([0, *[len(x) + 1 for x in lines]]).tolist()
    written = np.cumsum([0, *[bool(x.strip()) for x in lines]]).tolist()
    places, at = set(), 0
    for end in chunk_ends(lines):
        places.update((at, e) for e in range(at + 2, end + 1))
        places.update((a, end) for a in range(at + 1, end - 1))
        if at:
            places.add((at - 1, at + 1))
        at = end
    return [(a, e - a, starts[a], starts[e] - 1) for a, e in sorted(places) if written[e] - written[a] > 1]


class Parts:
    """The parts of several lines of a group of documents, by document, line and length."""

    def __init__(self, pdf):
        self.ids, self.raws = ids_of(pdf), pdf["text"].tolist()
        rows = [(d, *part) for d, raw in enumerate(self.raws) for part in multi_line_parts(raw)]
        self.doc, self.first, self.lines, self.start, self.stop = np.array(rows, np.int64).reshape(-1, 5).T.tolist()
        self.tag = np.fromiter((xxhash.xxh64_intdigest(self.bytes(i)) for i in range(len(rows))), np.uint64, len(rows))

    def bytes(self, i: int) -> bytes:
        return self.raws[self.doc[i]][self.start[i] : self.stop[i]]

    def packets(self, buckets: int):
        # a part repeated within one document repeats too: places, not documents, are told apart
        return tag_packets(self.tag, np.arange(len(self.tag)), buckets)

    def repeated(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts whose hash repeats, and for each the first of this group with its bytes."""
        chosen = np.flatnonzero(codes)
        known: dict[bytes, int] = {}  # documents and lines are in order: the first place stays
        return chosen, np.fromiter((known.setdefault(self.bytes(i), i) for i in chosen.tolist()), np.int64, len(chosen))


def _hex_int(n):
    """A non-negative int as eight hexadecimal digits, low byte first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)])


def _hash_question(buckets):
    return lambda pdf, _: Parts(pdf).packets(buckets)[0]


_SENT = "doc_group int, part binary, doc long, line long, chunk int"


def _byte_rows(buckets):
    """A group's repeated parts, each once with its first place."""

    def rows(pdf, answers):
        import pandas as pd

        pdf = ordered(pdf)
        parts, group = Parts(pdf), pdf["doc_group"].iloc[0]
        packets, _, where = parts.packets(buckets)
        codes = tag_codes(packets, answers, where)
        firsts = np.unique(parts.repeated(codes)[1]).tolist()
        out = [(group, parts.bytes(i), parts.ids[parts.doc[i]], parts.first[i], i) for i in firsts]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SENT.split(", ")])

    return rows


def _cut(buckets, with_text, more):
    def use(pdf, answers):
        import pandas as pd

        parts = Parts(pdf)
        packets, _, where = parts.packets(buckets)
        chosen, leader = parts.repeated(tag_codes(packets, answers, where))
        stays = np.frombuffer(answers.get(FIRST, b""), "<i4")
        gone = chosen[(leader != chosen) | ~np.isin(chosen, stays)]
        raws = parts.raws
        drop: dict[int, set[int]] = {}
        for i in gone.tolist():
            drop.setdefault(parts.doc[i], set()).update(range(parts.first[i], parts.first[i] + parts.lines[i]))
        n_lines = [raw.count(b"\n") + 1 if raw else 0 for raw in raws]
        n_removed, n_chunks, kept = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64), list(raws)
        for d, own in drop.items():
            kept[d] = b"\n".join([x for i, x in enumerate(raws[d].split(b"\n")) if i not in own])
            n_removed[d], n_chunks[d] = len(own), sum(i - 1 not in own for i in own)
        out = {"doc_id": pdf["doc_id"], "n_lines": np.array(n_lines, np.int64), "n_removed": n_removed, "n_chunks": n_chunks, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        if with_text:
            out["kept"] = kept
        return pd.DataFrame(out | {c: pdf[c] for c in more})

    return use


def remove_repeated_lines(docs: DataFrame, with_text: bool = False, more: tuple = (), id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Removes parts of several lines that occur at an earlier place in the corpus.

    One row per document: doc_id, n_lines, n_removed (lines), n_chunks (removed
    runs of lines), kept_sha256, with with_text the remaining text (kept, binary), and
    the columns of docs named in more. Places are ordered by doc_id, then line;
    a null doc_id ranks after all others and rows of one doc_id by an arbitrary
    but fixed order, so that one place always keeps a part. Null text is empty
    (no lines); a text of one line is never changed. An empty table gives no
    rows. Other columns are ignored.
    """
    _, total = text_bytes(docs, text_col)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in more])
    groups = grouped(plain, total, "doc_id", "text", more)
    buckets = pieces_of(total, bucket_bytes)
    repeats = ask(groups, _hash_question(buckets), lambda packets: shared_tags(packets, 2**31), buckets, total)
    sent = beside(groups, repeats, _byte_rows(buckets), _SENT, total)
    first = sent.groupBy("part").agg(F.min(F.struct("doc", "line", "doc_group", "chunk")).alias("p"))
    place = F.array_join(F.transform(F.sort_array(F.collect_list("p.chunk")), _hex_int), "")
    first = first.groupBy("p.doc_group").agg(F.unhex(place).alias("blob")).select("doc_group", F.lit(FIRST).alias("bucket"), "blob")
    told = repeats.select("doc_group", "bucket", "blob").union(first)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema if f.name in more]
    schema = ", ".join(["doc_id long, n_lines long, n_removed long, n_chunks long, kept_sha256 string", *["kept binary"] * with_text, *fields])
    return tell(groups, told, _cut(buckets, with_text, more), schema, total)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without repeated parts of several lines; columns are docs' own.

    A document stays, with what is left of its text, even if nothing is left.
    Null texts stay null.
    """
    names = docs.columns
    row = docs.select("doc_id", "text", *[F.col(c).alias(f"m{i}") for i, c in enumerate(names) if c not in ("doc_id", "text", "n_chars")], F.col("text").isNull().alias("none"))
    more = tuple(c for c in row.columns if c not in ("doc_id", "text"))
    out = remove_repeated_lines(row, with_text=True, more=more)
    text = F.when(~F.col("none"), F.col("kept").cast("string"))
    shown = {"doc_id": F.col("doc_id"), "text": text.alias("text"), "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars")}
    return out.select(*[shown.get(c, F.col(f"m{i}").alias(c)) for i, c in enumerate(names)])
