import random
import zlib
from collections import defaultdict

import numpy as np

from isospan.llm.packing import Packer, Tokens, cut_lengths, pack


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["a <|endoftext|> b", " leading", "two  spaces\n\n here \t x", "don't we'll I'M", "é𝄞 ß 漢字 ٣٤ ½", "\x00\x1f    x", "trailing "]


def test_ids_equal_the_named_tokenizers(spark):
    """Every document of a table of 10,000, odd texts and random Unicode."""
    rng = random.Random(6)
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text]
    spans = [(0, 0x80), (0, 0x250), (0x250, 0x2FF), (0x370, 0x1000), (0x2000, 0x2100), (0x3000, 0xA000), (0xE000, 0x10000), (0x1F300, 0x1FB00), (0x10000, 0x110000)]
    for _ in range(3000):
        lo, hi = rng.choice(spans)
        texts.append("".join(chr(rng.randrange(lo, hi)) if rng.random() < 0.8 else rng.choice(" \n\t'0aZ\u00a0\u2028") for _ in range(rng.randint(1, 60))))
    tokens = Tokens()
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        for text, want in zip(part, reference_ids(part)):
            assert np.frombuffer(tokens.encode(text), "<u4").tolist() == want, text[:100]


def test_cut_lengths():
    assert cut_lengths(2048) == [2048] and cut_lengths(2049) == [1, 2048] and cut_lengths(4096) == [2048, 2048] and cut_lengths(1) == [1]


def test_packer_takes_the_tightest_bin_and_closes_the_fullest():
    p = Packer(10, 2)
    assert p.place(6) == (0, 0) and p.place(5) == (1, 0)
    assert p.place(4) == (0, 6)  # exactly fills the tighter bin
    assert p.place(5) == (1, 5)
    assert p.place(9) == (2, 0) and p.place(8) == (3, 0) and p.place(7) == (4, 0)  # bin 2 closes
    assert p.place(1) == (3, 8) and p.open == 2


def check(df, capacity=2048):
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    ids = dict(zip(texts, reference_ids(list(texts.values()))))
    rows = pack(df, capacity).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        want = ids[d] + [0]
        own.sort(key=lambda r: r.piece)
        assert [r.length for r in own] == cut_lengths(len(want), capacity)
        at = 0
        for i, r in enumerate(own):
            assert (r.piece, r.start) == (i, at)
            assert r.ids_crc32 == zlib.crc32(np.asarray(want[at : at + r.length], "<u4").tobytes())
            at += r.length
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin), -(-sum(r.length for r in rows) // capacity)


def test_pack(documents, odd_texts, sample):
    check(documents(odd_texts), 64)
    bins, least = check(sample)
    assert bins <= 1.06 * least + 1


def test_degenerate(spark, documents):
    assert pack(documents([])).count() == 0
    df = spark.createDataFrame([(None, None), (None, None), (1, "a")], "doc_id long, text string")
    assert sorted(r.length for r in pack(df).collect()) == [1, 1, 2]


def test_sequences_are_within_a_hundredth_of_the_least(spark):
    rows = pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).selectExpr("sequence_id", "length").collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert len({r.sequence_id for r in rows}) <= 1.01 * least + 1
