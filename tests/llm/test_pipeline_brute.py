"""Each stage of the pipeline against a plain version on its own input."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
from test_jaccard import brute_kept
from test_linedup import plain_parts
from test_packing import check as check_packing

STAGE = dict(corpus_pipeline.STAGES)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_mix(rows):
    """{doc_id: words taken}: water filling, then whole epochs and a cut one."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(r.text)) for r in by[s]) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(size.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * size[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.discard(s)
    taken = {}
    for s in order:
        budget = min(int(target[s]), 3 * size[s])
        whole, rest = divmod(budget, size[s]) if size[s] else (0, 0)
        for r in sorted(by[s], key=lambda r: hashlib.md5(f"{r.doc_id}|{r.text or ''}".encode()).hexdigest()):
            n = len(words(r.text))
            taken[r.doc_id] = whole * n + min(n, rest)
            rest -= min(n, rest)
    return taken


def test_every_stage(spark, sample, sf):
    def through(name, docs):
        return spark.createDataFrame(STAGE[name](spark, docs, sf).collect(), sample.schema)

    docs = sample.where("doc_id < 120")
    kept = through("language_id", docs)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}

    lined, seen = through("line_dedup", kept), set()
    got = {r.doc_id: r.text for r in lined.collect()}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        lines = r.text.encode().split(b"\n")
        for first, n, part in plain_parts(r.text.encode()):
            if part in seen:
                lines[first : first + n] = [None] * n
            seen.add(part)
        assert got[r.doc_id] == b"\n".join(x for x in lines if x is not None).decode()

    single = through("simhash_near_dedup", lined)
    assert sorted(r.doc_id for r in single.collect()) == brute_kept([(r.doc_id, r.text) for r in lined.collect()])

    mixed, taken = through("mixing", single), defaultdict(int)
    for r in mixed.collect():
        taken[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in brute_mix(single.collect()).items() if v} == {k: v for k, v in taken.items() if v}

    check_packing(single)
