import hashlib
import random

import numpy as np

from isospan.llm.suffix_dedup import Runs, byte_codes, merge_transforms, remove_repeats, repeated_intervals, transform


def brute(rows, length=50):
    """{row: (n_bytes, n_removed, n_spans, sha)} for (doc_id, text) rows."""
    least, raws = {}, [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, **options).collect()
    want = sorted(((-1 if d is None else d), *w) for (d, _), w in zip(rows, brute(rows)))
    assert sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in got) == want


def passages(seed=3, n=60):
    rng = random.Random(seed)
    alphabet = "ab cdé"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(40, 200))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            a = rng.randint(0, 30)
            parts.append(s[a : a + rng.randint(45, 150)])
            parts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))))
        texts.append("".join(parts))
    return texts


def test_transforms_merge_to_the_order_of_all_suffixes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(60, 90))) for _ in range(20)] * 2
    for shard_bytes in (200, 10**6):
        owner, offset, interval = repeated_intervals(strings, 50, shard_bytes)
        windows = {}
        for o, a, i in zip(owner.tolist(), offset.tolist(), interval.tolist()):
            windows.setdefault(i, set()).add(strings[o][a : a + 50])
        assert all(len(w) == 1 for w in windows.values())
        assert len(windows) == len({w for s in windows.values() for w in s})
        assert len(owner) == sum(len(s) - 49 for s in strings)
    bwt, order = transform([b"banana"], 8, byte_codes([b"banana"]))
    entry, shared = merge_transforms([bwt], 8)
    assert len(order) == 7 and shared.tolist() == [0, 0, 1, 3, 0, 0, 2] and entry.tolist() == list(range(7))


def test_every_window_has_one_run():
    raws = [b"x" * 49, b"y" * 200, bytes(range(256)) * 3, b""]
    runs = Runs(raws, 50)
    assert int(runs.count.sum()) == sum(max(0, len(r) - 49) for r in raws)
    assert runs.count.max() <= 27 or (runs.flat[runs.first[runs.count > 27]] >= 0).all()


def test_brute_force(spark):
    texts = passages()
    rows = list(enumerate(texts)) + [(60, None), (61, ""), (62, "x" * 5000), (63, "x" * 120), (64, "ab" * 400), (65, "ab" * 300 + "x" * 60)]
    check(spark, rows)
    check(spark, rows, bucket_bytes=3000, hot_groups=0)


def test_repeated_and_null_ids(spark):
    a, b = passages(5, 2)
    long = "0123456789" * 7 + a
    rows = [(None, long), (None, long + b), (4, long), (4, long + b), (2, b * 2), (7, long)]
    check(spark, rows)


def test_sample_and_small_groups(spark, sample, monkeypatch):
    from isospan.llm import rounds

    monkeypatch.setattr(rounds, "GROUP_BYTES", 40_000)
    check(spark, [(r.doc_id, r.text) for r in sample.limit(120).collect()])


def test_empty(spark, documents):
    assert remove_repeats(documents([])).count() == 0
    got = remove_repeats(documents(["tiny"]), with_text=True).first()
    assert bytes(got.kept) == b"tiny"
