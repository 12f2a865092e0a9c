"""Packing tokenised documents into fixed-length sequences.

Tokens: one Arrow pass over whole texts, no shuffle; only piece lengths and
checksums leave it. Placement: pieces are dealt over a few tasks by hash (the
rows are some tens of bytes each) and placed by bounded-space online best-fit.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces_of, tokenizer_path

CAPACITY = 2048
OPEN_BINS = 4096
BIN_TASK_PIECES = 400_000
END_ID = 0


class Packer:
    """Bounded-space online best-fit: at most open_bins bins are open at a time.

    Open bins are kept by free space; a bitset has a bit for each free space
    that some open bin has, so that the tightest bin that fits is one
    lowest-set-bit away. When a bin too many is open, the fullest closes.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = self.made = 0

    def _put(self, free: int, bin_id: int) -> None:
        if free:
            self.by_free[free].append(bin_id)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        bin_id = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item; 1 <= length <= capacity."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id, self.made = self.capacity, self.made, self.made + 1
        self._put(free - length, bin_id)
        if self.open > self.open_bins:
            self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_id, self.capacity - free


class Tokens:
    """Ids of a byte-level BPE vocabulary, as little-endian 32-bit bytes.

    Read from the vocabulary's rank file, whose encoder gives the same ids as
    the merge file's at several times the speed (tests hold one to the other).
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes() if text else b""


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: all full but the first, which may be shorter."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_batches(capacity: int, vocabulary: str):
    def pieces(batches):
        import pyarrow as pa

        tokens = Tokens(vocabulary)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.encode(text.as_py() or "") + end
                at = 0
                for i, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for col, v in zip(out, (doc_id, i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]))):
                        col.append(v)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_piece_batches(capacity, vocabulary), _PIECES)


def _placed_batches(capacity: int, open_bins: int):
    def placed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [packer.place(n) for n in batch.column("length").to_pylist()]
            bins = pa.array([base + b for b, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, bins, pa.array([o for _, o in got], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return placed


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every document's tokens in sequences of at most capacity ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A document is its ids and one end id; only longer ones are cut, the
    first piece taking the remainder. Null or empty text is the end id alone.
    Null ids and repeated rows are documents like others; an empty table gives
    no rows. Each task packs some 400,000 pieces in hash order and numbers its
    sequences in a range of its own; the bins left open cost it at most their
    number once.
    """
    pieces = cut(token_pieces(docs, capacity, vocabulary, id_col, text_col))
    tasks = pieces_of(pieces.count(), BIN_TASK_PIECES)
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    order = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(1)), "start")
    return order.mapInArrow(_placed_batches(capacity, open_bins), f"{_PIECES}, sequence_id long, offset long")
