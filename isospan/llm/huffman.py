"""Token ids in files of canonical, length-limited Huffman codes.

Ids are written once to the shared folder; their counts over the whole table give
one code, whose lengths alone (package-merge, 16 bits at most for vocabularies
up to 65,536) stand in every file. A file's ids are cut into blocks of equal
count with the bit at which each begins, so that blocks are decoded independently
of each other: all blocks of a segment side by side, a table lookup an id, or
just those that cover one document.

File: MAGIC, the segments' bits, then a compressed index (code lengths, segments,
bit offsets of blocks, documents), its place and size, and MAGIC again.
"""

from __future__ import annotations

import posixpath
import re
import struct
import sys
import uuid
import zlib
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, open_store, pieces_of, shared_dir, tokenizer_path

MAGIC = b"IDHUF1\r\n"
BLOCK = 512
SEGMENT = 1024 * BLOCK
FILE_BYTES = 64_000_000
WRITER_IDS = 10_000_000  # ids of a writing task
COUNT_TASK_BYTES, COUNT_TASKS = 32_000_000, 4096
END_ID = 1
LEAST_LIMIT = 16
FRAME_BYTES = 4_000_000
TOGETHER = 8_000_000  # characters of texts whose distinct words are looked up once


# -- ids ------------------------------------------------------------------------


class WordIds:
    """Ids of a vocabulary whose words never cross white space, as little-endian bytes.

    Words are met again and again, so that each is encoded once and kept (KEPT of
    them at most). Texts of plain letters, digits and punctuation are cut as the
    library's pattern cuts them, and the pieces go straight to its merges; words
    with other characters go through the whole of it. Texts with the control
    characters that only Python takes for white space are encoded as they are.
    """

    KEPT = 400_000
    _PLAIN = re.compile("[ \t-\r!-~À-ÖØ-öø-ÿ]*")
    _PIECES = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
    _ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, name: str = "word_bpe_49k", path: str | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path(f"{name}.json"))
        self.size = self.tokenizer.get_vocab_size()
        self.width = id_type(self.size)
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = str.maketrans({chr(c): byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)})
        self._words = _Kept(self._word, self.KEPT)
        self._pieces = _Pieces(self.tokenizer.model.tokenize, self._letters, self.width, self.KEPT)

    def bytes_of(self, ids) -> bytes:
        return np.asarray(ids, self.width).tobytes()

    def _whole(self, text: str) -> bytes:
        return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._PIECES.findall(text.lower())))

    def _is_plain(self, text: str) -> bool:
        return self._PLAIN.fullmatch(text) is not None and "<|" not in text

    def _word(self, word: str) -> bytes:
        return self._plain(word) if self._is_plain(word) else self._whole(word)

    def encode(self, text: str) -> bytes:
        """The ids of a text, this vocabulary's width each."""
        if self._is_plain(text):
            return self._plain(text)
        if self._ODD.search(text):
            return self._whole(text)
        return b"".join(map(self._words.__getitem__, text.split()))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode of every text; plain ones are split together, and each distinct word is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        together = [i for i, t in enumerate(texts) if len(t) <= FRAME_BYTES and self._is_plain(t)]
        out = [b""] * len(texts)
        for i in {*range(len(texts))}.difference(together):
            out[i] = self.encode(texts[i])
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([texts[i] for i in together], pa.string())))
        words = split.flatten().dictionary_encode()
        pieces = self._pieces
        found = [pieces[w] if w.isalpha() else self._plain(w) for w in words.dictionary.to_pylist()]
        ids, sizes = np.frombuffer(b"".join(found), self.width), np.fromiter(map(len, found), np.int64, len(found)) // int(self.width[2])
        at = words.indices.to_numpy()
        n, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
        ends = np.cumsum(n)
        raw = ids[np.arange(int(n.sum())) + np.repeat(first - ends + n, n)].tobytes()
        cuts = (np.concatenate(([0], ends))[split.offsets.to_numpy()] * int(self.width[2])).tolist()
        for i, a, b in zip(together, cuts, cuts[1:]):
            out[i] = raw[a:b]
        return out


@lru_cache(2)
def word_ids(vocabulary: str) -> WordIds:
    """One for a Python worker, whose tasks share the words kept."""
    return WordIds(vocabulary)


class _Kept(dict):
    def __init__(self, make, most):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = got
        return got


class _Pieces(dict):
    """Ids of lower-case pieces, by the merges alone."""

    def __init__(self, merge, letters, width, most):
        super().__init__()
        self.merge, self.letters, self.kind, self.most = merge, letters, "HI"[width == "<u4"], most
        self.swap = sys.byteorder == "big"

    def __missing__(self, piece):
        ids = array(self.kind, [t.id for t in self.merge(piece if piece.isascii() else piece.translate(self.letters))])
        if self.swap:
            ids.byteswap()
        got = ids.tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = got
        return got


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


# -- codes ----------------------------------------------------------------------


def code_lengths(counts, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 for ids that don't occur."""
    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit in codes of {limit} bits")
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    own, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = own[: len(own) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        own = both[rank]
    take = 2 * n - 2
    for leaf in reversed(levels):
        singles = int(leaf[:take].sum())
        out[order[:singles]] += 1
        take = 2 * (take - singles)
    return out


class Code(NamedTuple):
    """A canonical code: code and length of each id, and the decoding table."""

    lengths: np.ndarray
    codes: np.ndarray
    bits: int
    table: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        bits = int(lengths.max(initial=0))
        spans = (1 << (bits - lengths[order].astype(np.int64))) if len(order) else np.zeros(0, np.int64)
        starts = np.cumsum(spans) - spans
        codes = np.zeros(len(lengths), np.uint32)
        codes[order] = starts >> (bits - lengths[order].astype(np.int64))
        table = np.zeros(1 << bits, np.uint32)
        filled = np.repeat(order.astype(np.uint32), spans)
        table[: len(filled)] = filled
        return cls(lengths, codes, bits, table)


def encode(ids: np.ndarray, code: Code, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of each block)."""
    lengths = code.lengths[ids].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = int(ends[-1]) if len(ids) else 0
    word = code.codes[ids].astype(np.uint64) << (40 - lengths - (starts & 7)).astype(np.uint64)
    at, size = starts >> 3, (total + 7) // 8
    out = np.zeros(size + 5, np.float64)
    for k in range(5 if code.bits > 25 else 4 if code.bits > 17 else 3):
        out += np.bincount(at + k, ((word >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.float64), size + 5)
    return out[:size].astype(np.uint8).tobytes(), starts[::block].astype(np.uint32)


def decode(data: bytes, offsets: np.ndarray, n: int, code: Code, block: int = BLOCK) -> np.ndarray:
    """The n ids of blocks that begin at bit offsets of data, the last one maybe shorter."""
    if not n:
        return np.zeros(0, np.uint32)
    d = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    window = np.zeros(len(d) - 4, np.uint64)
    for k in range(5):
        window |= d[k : k + len(window)] << np.uint64(32 - 8 * k)
    last, down = len(window) - 1, 40 - code.bits
    at, steps = offsets.astype(np.int64), min(block, n)
    out = np.empty((steps, len(offsets)), np.uint32)
    mask = np.uint64((1 << code.bits) - 1)
    lengths = code.lengths.astype(np.int64)
    for k in range(steps):
        got = code.table[(window[np.minimum(at >> 3, last)] >> (down - (at & 7)).astype(np.uint64)) & mask]
        out[k] = got
        at += lengths[got]
    if len(offsets) == 1:
        return out[:n, 0]
    return out.T.ravel()[:n]


# -- files ----------------------------------------------------------------------


class FileWriter:
    """One file of documents' ids, in the order given."""

    def __init__(self, stream, code: Code):
        self.stream, self.code, self.size = stream, code, 0
        self.pending, self.held = [], 0
        self.segments, self.offsets, self.documents = [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def _segment(self, ids: np.ndarray) -> None:
        data, offsets = encode(ids, self.code)
        self.segments.append((self.size, len(data), len(ids)))
        self.offsets.append(offsets)
        self._put(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= SEGMENT:
            ids = np.concatenate(self.pending)
            whole = len(ids) // SEGMENT * SEGMENT
            for at in range(0, whole, SEGMENT):
                self._segment(ids[at : at + SEGMENT])
            self.pending, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._segment(np.concatenate(self.pending))
        ids = np.array([d or 0 for d, _ in self.documents], "<i8")
        none = np.packbits(np.array([d is None for d, _ in self.documents], bool))
        counts = np.array([n for _, n in self.documents], "<i8")
        parts = [self.code.lengths.tobytes(), np.array(self.segments, "<i8").tobytes(), np.concatenate(self.offsets).astype("<u4").tobytes() if self.offsets else b"", ids.tobytes(), none.tobytes(), counts.tobytes()]
        index = zlib.compress(struct.pack("<6q", *map(len, parts)) + b"".join(parts), 6)
        place = self.size
        self._put(index)
        self._put(struct.pack("<qqI", place, len(index), zlib.crc32(index)) + MAGIC)
        self.stream.close()


class FileReader:
    """Documents of one file; source has read_at(size, offset) and size()."""

    TAIL = 20 + len(MAGIC)

    def __init__(self, source):
        self.source = source
        tail = source.read_at(self.TAIL, source.size() - self.TAIL)
        place, size, crc = struct.unpack("<qqI", tail[:20])
        index = source.read_at(size, place)
        if tail[20:] != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole file of token ids")
        raw = zlib.decompress(index)
        parts, at = [], 48
        for n in struct.unpack("<6q", raw[:48]):
            parts.append(raw[at : at + n])
            at += n
        lengths, segments, offsets, ids, none, counts = parts
        self.code = Code.of(np.frombuffer(lengths, np.uint8))
        self.segments, self.offsets = np.frombuffer(segments, "<i8").reshape(-1, 3), np.frombuffer(offsets, "<u4")
        self.counts = np.frombuffer(counts, "<i8")
        null = np.unpackbits(np.frombuffer(none, np.uint8))[: len(self.counts)]
        self.ids = [None if m else d for d, m in zip(np.frombuffer(ids, "<i8").tolist(), null.tolist())]
        blocks = -(-self.segments[:, 2] // BLOCK)
        self.first_block, self.first_id = np.cumsum(blocks) - blocks, np.cumsum(self.segments[:, 2]) - self.segments[:, 2]

    def _part(self, s: int, a: int, b: int) -> np.ndarray:
        """Ids a to b of segment s, from the bytes of the blocks that cover them."""
        place, size, n = self.segments[s].tolist()
        low, high = a // BLOCK, -(-b // BLOCK)
        own = self.offsets[self.first_block[s] + low : self.first_block[s] + high].astype(np.int64)
        start = int(own[0]) >> 3
        more = self.first_block[s] + high
        is_last = high * BLOCK >= n
        stop = size if is_last else (int(self.offsets[more]) + 7) >> 3
        data = self.source.read_at(stop - start, place + start)
        return decode(data, own - 8 * start, min(n, high * BLOCK) - low * BLOCK, self.code)[a - low * BLOCK : b - low * BLOCK]

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids start to start + count of the file."""
        out, s = [np.zeros(0, np.uint32)], int(np.searchsorted(self.first_id, start, "right")) - 1
        while count > 0:
            a = start - int(self.first_id[s])
            b = min(int(self.segments[s, 2]), a + count)
            out.append(self._part(s, a, b))
            start, count, s = start + b - a, count - (b - a), s + 1
        return np.concatenate(out)

    def documents(self):
        """(doc_id, ids) in order; one segment is held beside a document."""
        held, s = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.ids, self.counts.tolist()):
            parts, have = [held], len(held)
            while have < n:
                more = self._part(s, 0, int(self.segments[s, 2]))
                parts.append(more)
                have, s = have + len(more), s + 1
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield doc_id, held[:n]
            held = held[n:]


_TOKENS = "doc_id long, n long, crc long, ids binary"


def _token_batches(vocabulary: str, end_id: int):
    def tokens(batches):
        import gc

        import pyarrow as pa

        gc.disable()  # no cycles are made here, and a pass over all words kept is long
        try:
            yield from frames(batches, pa)
        finally:
            gc.enable()

    def frames(batches, pa):
        words = word_ids(vocabulary)
        end = words.bytes_of([end_id])
        for batch in batches:
            doc_ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > TOGETHER:
                    yield frame(rows_of(words, end, doc_ids, texts), pa)
                    doc_ids, texts, held = [], [], 0
            yield frame(rows_of(words, end, doc_ids, texts), pa)

    def rows_of(words, end, doc_ids, texts):
        coded = [ids + end for ids in words.encode_all(texts)]
        return [(doc_id, len(ids) // int(words.width[2]), zlib.crc32(ids), ids) for doc_id, ids in zip(doc_ids, coded)]

    def frame(rows, pa):
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n", "crc", "ids"])

    return tokens


def _counted(width: str, size: int):
    def counted(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.binary())
            if len(column):  # the bytes of a batch's rows stand one after another
                ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                ids = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(width)
                for at in range(0, len(ids), 1 << 20):
                    total += np.bincount(ids[at : at + (1 << 20)], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    return counted


class TokenFiles:
    """Files of token ids under one shared folder, and the order they stand in."""

    def __init__(self, spark: SparkSession, root: str, files: DataFrame):
        self.spark, self.root, self.files = spark, root, files

    @classmethod
    def write(cls, docs: DataFrame, vocabulary: str = "word_bpe_49k", end_id: int = END_ID, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
        """Encodes every text, ends it with end_id and writes it in ascending id order."""
        spark = docs.sparkSession
        root = root or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        size = WordIds(vocabulary).size
        width = id_type(size)
        plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        plain.mapInArrow(_token_batches(vocabulary, end_id), _TOKENS).write.option("compression", "zstd").parquet(f"{root}/ids")
        tokens = spark.read.schema(_TOKENS).parquet(f"{root}/ids")
        total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        tasks = min(COUNT_TASKS, pieces_of(total * int(width[2]), COUNT_TASK_BYTES))
        counted = tokens.select("ids").coalesce(tasks).mapInArrow(_counted(width, size), "id int, n long")
        counts = np.zeros(size, np.int64)
        for row in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
            counts[row["id"]] = row["n"]
        code = spark.sparkContext.broadcast(Code.of(code_lengths(counts, max(LEAST_LIMIT, (size - 1).bit_length()))))

        def written(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            store, folder = open_store(root)
            part, out, name, got = TaskContext.get().partitionId(), None, None, []

            def close():
                nonlocal out
                out.close()
                got.append((name, part, len(got), len(out.documents), sum(n for _, n in out.documents), out.size))
                out = None

            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.ids"
                        out = FileWriter(store.open_output_stream(posixpath.join(folder, name), compression=None), code.value)
                    out.add(doc_id, np.frombuffer(ids.as_buffer(), width))
                    if out.size >= FILE_BYTES:
                        close()
            if out is not None:
                close()
            cols = list(zip(*got)) if got else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int32()] * 2, *[pa.int64()] * 3))], names=["file", "part", "seq", "docs", "ids", "bytes"])

        keys = [F.col("doc_id").asc_nulls_last(), F.col("n"), F.col("crc")]
        ordered = tokens.repartitionByRange(pieces_of(total, WRITER_IDS), *keys).sortWithinPartitions(*keys)
        files = cut(ordered.select("doc_id", "ids").mapInArrow(written, "file string, part int, seq int, docs long, ids long, bytes long"))
        # in one task, as there is but a row for each file
        before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return cls(spark, root, cut(files.withColumn("before", before)))

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of every document, decoded from the files;
        ids are little-endian unsigned 32-bit integers."""
        root = self.root

        def read(batches):
            import pyarrow as pa

            store, folder = open_store(root)

            def frame(rows):
                cols = list(zip(*rows)) if rows else [[]] * 4
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

            for batch in batches:
                for file, at in zip(*(c.to_pylist() for c in batch.columns)):
                    with store.open_input_file(posixpath.join(folder, file)) as source:
                        rows, held = [], 0
                        for doc_id, ids in FileReader(source).documents():
                            rows.append((doc_id, at, len(ids), ids.astype("<u4").tobytes()))
                            at, held = at + len(ids), held + 4 * len(ids)
                            if held > FRAME_BYTES:
                                yield frame(rows)
                                rows, held = [], 0
                        yield frame(rows)

        places = self.files.select("file", "before")
        return places.repartition(max(1, self.files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, vocabulary: str = "word_bpe_49k", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every document's ids to files, reads them back and digests them.

    One row per document: doc_id, start, n_tokens, ids_crc32. Null and empty
    texts are the end id alone; null ids come last; rows of one id are ordered by
    length and checksum; very long texts span segments. An empty table writes no file and gives no
    rows; other columns are ignored.
    """
    read = TokenFiles.write(docs, vocabulary, end_id, id_col=id_col, text_col=text_col).read()
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
