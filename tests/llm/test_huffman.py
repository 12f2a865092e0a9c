import heapq
import io
import random
import zlib

import numpy as np
import pytest

from isospan.llm import huffman as H
from isospan.llm.huffman import Code, FileReader, FileWriter, TokenFiles, WordIds, code_lengths, decode, encode, token_digests


def named_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


TEXTS = ["a <|endoftext|> b<|startoftext|>c", "Don't WE'LL I'M it'sa 'S .'s", "é𝄞 ß 漢字 ٣٤ ½ ŸÿÀ×÷", "\x00\x1c\x1f    x\x85y\xa0z", "ΑΣ ΟΔΥΣΣΕΥΣ Σ", "İstanbul ǅ ﬁ", "é ́ ạ̀", "x" * 500 + "1234", "a b　c﻿d", "naïve...co-op!!'?", "<| <||> |>"]


def test_ids_equal_the_library_over_whole_texts(spark):
    """Every document of a table of 10,000, odd texts and random Unicode."""
    rng = random.Random(7)
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("doc_id % 5 = 0 OR length(text) < 500").collect() if r.text]
    spans = [(0, 0x80), (0, 0x250), (0x250, 0x2FF), (0x300, 0x1000), (0x2000, 0x2100), (0x3000, 0xA000), (0xE000, 0x10000), (0x1F300, 0x1FB00), (0x10000, 0x110000)]
    for _ in range(3000):
        lo, hi = rng.choice(spans)
        texts.append("".join(chr(rng.randrange(lo, hi)) if rng.random() < 0.8 else rng.choice(" \n\t'0aZ  ") for _ in range(rng.randint(1, 60))))
    words, whole = WordIds(), named_tokenizer()
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        for text, want in zip(part, whole.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(words.encode(text), words.width).tolist() == want.ids, text[:100]


def test_texts_together_get_the_ids_of_each(monkeypatch):
    """Split together, a distinct word is looked up once; long and odd texts go one by one."""
    monkeypatch.setattr(H, "FRAME_BYTES", 300)
    texts = [*TEXTS, "", "  lead \t\n trail\x0b\x0cx ", "\r\n", "É'S 12x ÿß", "the Cat, the cat. " * 10, "the cat " * 50]
    words, whole, asked = WordIds(), named_tokenizer(), []
    monkeypatch.setattr(type(words._pieces), "__getitem__", lambda self, key: asked.append(key) or (dict.__getitem__(self, key) if key in self else self.__missing__(key)), raising=False)
    for part in (texts, texts[::-1], texts[:1], [""], []):
        want = [np.asarray(x.ids, words.width).tobytes() for x in whole.encode_batch(part, add_special_tokens=False)]
        assert words.encode_all(part) == want
    asked.clear()
    words.encode_all(["the cat " * 30] * 9)
    assert sorted(asked) == ["cat", "the"]


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def limited_cost(counts, limit):
    """Least total length by trying every count of codes of each length."""
    own = sorted((c for c in counts if c), reverse=True)
    best = [None]

    def go(i, depth, room, cost):  # room: free nodes at this depth
        if i == len(own):
            best[0] = cost if best[0] is None else min(best[0], cost)
            return
        if depth == limit:
            if len(own) - i <= room:
                go(len(own), depth, 0, cost + depth * sum(own[i:]))
            return
        for k in range(min(room, len(own) - i) + 1):
            go(i + k, depth + 1, (room - k) * 2, cost + depth * sum(own[i : i + k]))

    go(0, 1, 2, 0)
    return best[0]


def test_lengths_are_least_and_limited():
    rng = random.Random(3)
    for _ in range(200):
        counts = [rng.choice([0, 1, rng.randint(1, 20), 2 ** rng.randint(0, 12)]) for _ in range(rng.randint(2, 9))]
        n = sum(c > 0 for c in counts)
        if n < 2:
            continue
        for limit in {(n - 1).bit_length(), 4, 20} - {x for x in range(5) if 1 << x < n}:
            lengths = code_lengths(counts, limit)
            assert lengths.max() <= limit and all((l > 0) == (c > 0) for l, c in zip(lengths, counts))
            cost = sum(int(l) * c for l, c in zip(lengths, counts))
            assert cost == (huffman_cost(counts) if limit == 20 else limited_cost(counts, limit))
    assert code_lengths([0, 7, 0], 16).tolist() == [0, 1, 0] and code_lengths([], 16).tolist() == []


def test_codes_are_canonical_and_prefix_free():
    rng = random.Random(4)
    code = Code.of(code_lengths([rng.randint(0, 1000) ** 3 for _ in range(300)], 12))
    words = sorted((int(n), i, format(int(code.codes[i]), f"0{n}b")) for i, n in enumerate(code.lengths) if n)
    assert [w for *_, w in words] == sorted(w for *_, w in words)
    assert not any(b.startswith(a) for (*_, a), (*_, b) in zip(words, words[1:]))


@pytest.mark.parametrize("size,limit", [(1, 16), (2, 16), (700, 10), (70_000, 20), (300, 24)])
def test_round_trip_of_blocks(size, limit):
    rng = np.random.default_rng(size)
    weights = 0.5 ** np.arange(size) if size == 300 else rng.zipf(1.3, size)
    ids = rng.choice(size, 5000, p=weights / weights.sum())
    code = Code.of(code_lengths(np.bincount(ids, minlength=size) + (np.int64(2) ** np.minimum(60, size - np.arange(size)) if size == 300 else 0), limit))
    for n in (0, 1, 63, 64, 65, 5000):
        data, offsets = encode(ids[:n], code, 64)
        assert decode(data, offsets, n, code, 64).tolist() == ids[:n].tolist()


class Source(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        self.asked = getattr(self, "asked", 0) + n
        return self.read(n)

    def size(self):
        return len(self.getvalue())


def test_file_round_trip_and_random_reads(monkeypatch):
    monkeypatch.setattr(H, "SEGMENT", 4 * H.BLOCK)
    rng = np.random.default_rng(1)
    docs = [(None if i == 5 else i - 3, rng.integers(0, 900, n)) for i, n in enumerate([0, 1, 511, 512, 513, 3, 9000, 1, 2048, 0])]
    code = Code.of(code_lengths(np.bincount(np.concatenate([d for _, d in docs]), minlength=1000), 16))
    out = Source()
    out.close = lambda: None
    w = FileWriter(out, code)
    for doc_id, ids in docs:
        w.add(doc_id, ids)
    w.close()
    reader = FileReader(out)
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(d, x.tolist()) for d, x in docs]
    whole = np.concatenate([x for _, x in docs])
    for start, count in [(0, 1), (511, 2), (700, 5000), (len(whole) - 1, 1), (2047, 2), (4096, 0)]:
        assert reader.read(start, count).tolist() == whole[start : start + count].tolist()
    out.asked = 0
    reader.read(3000, 10)
    assert out.asked <= 2 * H.BLOCK * 2
    broken = Source(out.getvalue()[:-40] + b"\0" + out.getvalue()[-39:])
    with pytest.raises(ValueError):
        FileReader(broken)


def expected(rows):
    whole, at, out = named_tokenizer(), 0, []
    coded = [(d, len(ids), zlib.crc32(np.asarray(ids, "<u2").tobytes()), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for d, ids in ((d, whole.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows)]
    for d, n, _, crc in sorted(coded, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        out.append((d, at, n, crc))
        at += n
    return out


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in df.collect()), key=lambda r: r[1])


def test_documents(spark, documents, odd_texts, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents([*odd_texts, *TEXTS, "long text. " * 300_000], -3).collect()]
    assert got(token_digests(documents([*odd_texts, *TEXTS, "long text. " * 300_000], -3).repartition(5))) == expected(rows)
    monkeypatch.setattr(H, "WRITER_IDS", 5000)
    monkeypatch.setattr(H, "FILE_BYTES", 3000)
    assert got(token_digests(documents([*odd_texts, *TEXTS], -3).repartition(5))) == expected(rows[:-1])


def test_registered_query(spark, sf):
    from isospan.llm.queries import op12_token_files

    assert got(op12_token_files(spark, sf)) == expected([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_degenerate(spark, documents):
    assert token_digests(documents([])).count() == 0
    rows = [(None, None), (None, "b"), (1, "a"), (1, "a"), (1, None), (-5, " ")]
    assert got(token_digests(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_ids_come_back(spark, documents):
    rows = {r.doc_id: r.ids for r in TokenFiles.write(documents(["hello world", None])).read().collect()}
    assert np.frombuffer(rows[0], "<u4").tolist() == [*named_tokenizer().encode("hello world", add_special_tokens=False).ids, 1]
    assert np.frombuffer(rows[1], "<u4").tolist() == [1]


def test_ids_of_a_batch_are_counted_in_one_pass(monkeypatch):
    import pyarrow as pa

    rows = [np.arange(n, dtype="<u2").tobytes() for n in (3, 1, 5)]
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    column = pa.array([b"\x07\x00", *rows], pa.binary())[1:]
    (out,) = H._counted("<u2", 9)(iter([pa.RecordBatch.from_arrays([column], names=["ids"])]))
    assert out.to_pydict() == {"id": [0, 1, 2, 3, 4], "n": [3, 2, 2, 1, 1]}
    assert len(calls) == 1
