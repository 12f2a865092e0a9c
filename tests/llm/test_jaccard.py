import random

import corpus_pipeline
import xxhash

from isospan.llm.simhash import keep_one


def grams(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_kept(rows, least=0.8):
    """doc_ids of the least document of each component, by whole sets."""
    sets, root = {d: grams(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(d) for d in sets})


def edited(words, share, rng):
    """words with single ones replaced until some share of the shingles is new."""
    out = list(words)
    for i in rng.sample(range(len(words) // 5), round(share * len(words) / 5)):
        out[5 * i] = f"new{rng.random()}"
    return out


def test_stage_rule(spark, documents, sf):
    rng = random.Random(3)
    texts = []
    for n in range(60):
        words = [f"w{rng.random()}" for _ in range(400)]
        texts += [" ".join(words), " ".join(edited(words, 0.06 + n * 0.002, rng))]
    docs = documents(texts)
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf).collect())
    assert got == brute_kept(list(enumerate(texts)))
    assert 60 < len(got) < 120


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 1000")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 4000]
    short = docs.where("length(coalesce(text, '')) < 4000")
    assert sorted(r.doc_id for r in keep_one(short).collect()) == brute_kept(rows)


def test_rows_of_one_id(spark):
    whole = "a whole document with words enough to be held as a text of its own"
    rows = [(1, whole), (1, "a fragment"), (1, whole), (2, whole), (2, "quite another text that has the id of a copy"), (None, whole), (None, "none has this one")]
    got = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted({rows[0], rows[1], rows[4], rows[6]}, key=str)


def test_large_groups_are_dealt_and_lose_no_link(spark, documents, monkeypatch):
    from isospan.llm import jaccard

    monkeypatch.setattr(jaccard, "PART_NODES", 7)
    rng = random.Random(4)
    base, texts = [f"w{i}" for i in range(300)], []
    for n in range(60):  # near one text; near such a one, not the first; a chain
        texts.append(" ".join(edited(base, 0.02, rng)))
        texts.append(" ".join(edited(texts[-1].split(), 0.1, rng)))
    for n in range(8):
        base = edited(base, 0.1, rng)
        texts.append(" ".join(base))
    got = sorted(r.doc_id for r in keep_one(documents(texts)).collect())
    assert got == brute_kept(list(enumerate(texts)))


def test_template_family(spark, documents, monkeypatch):
    """Texts of a template, less alike than the bound: met by prefixes, pairs in it found."""
    from isospan.llm import jaccard

    monkeypatch.setattr(jaccard, "PART_NODES", 20)
    rng, template = random.Random(5), [f"t{i}" for i in range(120)]
    texts = []
    for n in range(150):
        texts.append(" ".join([*template, *[f"own{rng.random()}" for _ in range(25)]]))
        if n % 5 == 0:
            texts.append(" ".join(edited(texts[-1].split(), 0.08, rng)))
    rng.shuffle(texts)
    got = sorted(r.doc_id for r in keep_one(documents(texts)).collect())
    assert got == brute_kept(list(enumerate(texts)))


def test_a_part_of_a_template_family_is_cheap():
    """500 texts of similarity 0.6, no two of which are tried on each other."""
    from isospan.llm import jaccard

    rng, tried = random.Random(6), []
    sets = [jaccard.shingle_set(" ".join([f"t{i}" for i in range(120)] + [f"o{rng.random()}" for _ in range(40)]).encode()) for _ in range(500)]
    similar = jaccard.similar
    jaccard.similar = lambda a, b, least: tried.append(1) or similar(a, b, least)
    try:
        assert jaccard.set_links(list(range(500)), sets) == []
    finally:
        jaccard.similar = similar
    assert len(tried) < 500 * (jaccard.FEW + 2)


def test_links_are_those_of_all_pairs():
    from isospan.llm import jaccard

    rng = random.Random(7)
    for n in (1, 2, 40, 120):
        base = [f"w{i}" for i in range(60)]
        texts = [" ".join(edited(base, rng.choice([0.0, 0.1, 0.3, 0.6]), rng)) for _ in range(n)] + [""]
        kept = brute_kept(list(enumerate(texts)))
        root = list(range(len(texts)))
        for u, v in jaccard.set_links(root[:], [jaccard.shingle_set(t.encode()) for t in texts]):
            x, y = sorted((root[u], root[v]))
            root = [x if r == y else r for r in root]
        assert sorted(set(root)) == kept


def plain_print(text):
    h = [xxhash.xxh3_64_intdigest(" ".join(g).encode()) for g in grams(text)] if (text or "").split() else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_print_of_a_set():
    from isospan.llm.jaccard import print_of, shingle_set

    for text in ("", " ", "one", "a b c d e f", "a b c d e a b c d e a b", "é ß " * 90):
        assert print_of(shingle_set(text.encode())) % 2**64 == plain_print(text)


def test_stage_links_by_fingerprints_first(spark, documents, monkeypatch):
    """Without the step for the rest: fingerprints of 7 bits propose, whole sets confirm."""
    from isospan.llm import simhash

    given = []

    def no_rest(members, texts, labels, *rest):
        given.append({r.node for r in labels.collect()})
        return spark.createDataFrame([], "u long, v long")

    monkeypatch.setattr(simhash, "rest_links", no_rest)
    rng, texts = random.Random(8), []
    for n in range(40):
        words = [f"w{rng.random()}" for _ in range(300)]
        texts += [" ".join(words), " ".join(edited(words, 0.01 + n * 0.008, rng))]
    prints = [plain_print(t) for t in texts]
    pairs = [((prints[i] ^ prints[i + 1]).bit_count(), brute_kept([(0, texts[i]), (1, texts[i + 1])]) == [0]) for i in range(0, 80, 2)]
    near = [like for bits, like in pairs if bits <= 7]
    assert any(near) and not all(near) and any(like for bits, like in pairs if bits > 7)
    got = sorted(r.doc_id for r in simhash.keep_one(documents(texts)).collect())
    assert got == [i for i in range(80) if i % 2 == 0 or not (pairs[i // 2][0] <= 7 and pairs[i // 2][1])]
    assert len(given[0]) == 80 - len(got)


def test_labels_are_links_already():
    from isospan.llm import jaccard

    base = [f"w{i}" for i in range(60)]
    sets = [jaccard.shingle_set(" ".join([*base[n:], *base[:n]]).encode()) for n in range(3)]
    assert len(jaccard.set_links([4, 5, 6], sets)) == 2
    assert len(jaccard.set_links([4, 5, 6], sets, labels=[4, 4, 6])) == 1
    assert jaccard.set_links([4, 5, 6], sets, labels=[4, 4, 4]) == []
