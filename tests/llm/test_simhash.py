import re

import numpy as np
import xxhash

from isospan.llm.simhash import fingerprint_bytes, fingerprint_links, keep_one, local_roots, near_duplicates


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, most=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(df):
    prints = {r.doc_id: brute_print(r.text) for r in df.collect()}
    want = brute_components(prints)
    got = near_duplicates(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_matches_brute_force(documents, odd_texts):
    base = "the quick brown fox jumps over the lazy dog and then runs away from it all day long " * 4
    check(documents(odd_texts + [base, base + "more", base.upper(), "A B\x0bC D E", "a b c d e", "A B c"]))


def test_on_sample(sample):
    check(sample)


def near_sets(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    flips = [base]
    for _ in range(3):
        mask = np.zeros(n, np.uint64)
        for _ in range(3):
            mask |= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        flips.append(base ^ mask)
    return np.unique(np.concatenate(flips))


def test_gray_index_finds_every_component():
    prints = near_sets(3, 120)
    own, root = local_roots(prints)
    want = brute_components({int(p): int(p) for p in prints})
    classes = {}
    for p, r in zip(own.tolist(), root.tolist()):
        classes.setdefault(r, set()).add(p)
    truth = {}
    for p, r in want.items():
        truth.setdefault(r, set()).add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, truth.values()))


def test_split_groups_lose_no_link(spark):
    from isospan.llm.simhash import star_components

    prints = near_sets(5, 200)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    want = brute_components({int(p): int(p) for p in prints})
    for group, split in ((50, 3), (10**6, 10**6)):
        stars = {r.u: r.v for r in star_components(fingerprint_links(df, len(prints), group_rows=group, split_rows=split)).collect()}
        rooted = {}
        for p in prints:
            i = int(p.view(np.int64))
            rooted.setdefault(stars.get(i, i), set()).add(int(p))
        truth = {}
        for p, r in want.items():
            truth.setdefault(r, set()).add(p)
        assert sorted(map(sorted, rooted.values())) == sorted(map(sorted, truth.values()))


def test_keep_one_and_nulls(spark, documents):
    text = "some words that say enough to be a text of its own here"
    df = documents([text, text, None, "", "other thing entirely told in a few words more"])
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [0, 2, 4]
    df = df.union(df)
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [0, 2, 4]
    none = spark.createDataFrame([(None, "a b c"), (None, None), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(none).collect()}
    assert got == {(None, None), (None, 3), (3, 3)}
    assert near_duplicates(documents([])).count() == 0


def test_zero_for_wordless():
    assert fingerprint_bytes(b" \n ") == b"\0" * 8 == fingerprint_bytes(None)


def test_star_links_are_closed_in_batches(monkeypatch):
    import pyarrow as pa

    from isospan.llm import simhash as S

    rng = np.random.default_rng(5)
    u, v = rng.integers(-500, 500, (2, 900))
    want = {i: i for i in {*u.tolist(), *v.tolist()}}
    for _ in range(1000):
        for a, b in zip(u.tolist(), v.tolist()):
            want[a] = want[b] = min(want[a], want[b])
    monkeypatch.setattr(S, "STAR_PART_ROWS", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 7]), pa.array(v[i : i + 7])], names=["u", "v"]) for i in range(0, 900, 7)]
    (got,) = S._star_batches(batches)
    assert dict(zip(*(c.to_pylist() for c in got.columns))) == {a: b for a, b in want.items() if a != b}
    assert [b.num_rows for b in S._star_batches([])] == [0]


def test_components_of_paths_and_hubs_take_few_jobs(spark):
    from isospan.llm.simhash import star_components

    path, hub = [(i, i + 1) for i in range(2000)], [(10_000 + i, 9_000) for i in range(1500)]
    links = spark.createDataFrame([*path[::-1], *hub, (7, 7)], "u long, v long").repartition(6)
    want = [*((i, 0) for i in range(1, 2001)), *((10_000 + i, 9_000) for i in range(1500))]
    sc = spark.sparkContext
    for parts, most in ((1, 4), (3, 40)):
        sc.setJobGroup(f"stars-{parts}", "")
        stars = star_components(links, parts)
        sc.setJobGroup("other", "")
        assert sorted(map(tuple, stars.collect())) == want
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"stars-{parts}"))
        assert jobs <= most  # each round of joins takes some ten: their plans and threads are the driver's
