import math
import random

import numpy as np
import pytest

from isospan.llm import whitening as W
from isospan.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, x string, dim string"


def expected(rows, components=4):
    """vec_id -> [(n, deviation, whitened, explained)] by whole-matrix numpy on exact sums."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (dim - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(np.cov(centred.T, bias=True).reshape(dim, dim))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in kept:
        d = np.array([(n * c - s) / n for c, s in zip(v, sums)])
        out.setdefault(i, []).append((n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), d @ vectors / np.sqrt(values), values / np.trace(np.cov(centred.T, bias=True).reshape(dim, dim))))
    return out


def check(df, rows):
    want, got = expected(rows), {}
    for r in df.collect():
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(got) == set(want)
    signs = {}
    for i, own in want.items():
        assert sorted(got[i]) == list(range(1, len(own[0][2]) + 1))
        for c, rs in got[i].items():
            assert len(rs) == len(own)
            assert sorted(r.deviation for r in rs) == sorted(w[1] for w in own)
            for r, w in zip(sorted(rs, key=lambda r: r.deviation), sorted(own, key=lambda w: w[1])):
                assert r.n == w[0] and r.explained == pytest.approx(w[3][c - 1], rel=1e-9)
                sign = signs.setdefault(c, 1.0 if abs(r.whitened - w[2][c - 1]) < abs(r.whitened + w[2][c - 1]) else -1.0)
                assert r.whitened == pytest.approx(sign * w[2][c - 1], rel=1e-7, abs=1e-7)
                assert r.identity_error < 1e-9


def vectors(n, dim, seed=5):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * np.linspace(1, 0.2, dim) + 3.0
    return [(i, x.tolist(), "clash", None) for i, x in enumerate(v)]


def test_against_whole_matrix(spark):
    rows = vectors(300, 6)
    rows += [(900, rows[7][1], "a", "b"), (901, rows[7][1], "a", "b"), (902, None, "a", "b"), (903, [1.0, None, 2.0, 0.0, 0.0, 0.0], "", ""), (904, [float("nan")] * 6, "", ""), (905, [float("inf")] + [0.0] * 5, "", ""), (906, [-0.0] * 6, "", ""), (7, rows[8][1], "", ""), (None, rows[9][1], "", ""), (907, [0.5, 0.25], "", "")]
    check(whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)), rows)


def test_registered_query(spark, sf):
    from isospan.llm.queries import op11_whitening

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(op11_whitening(spark, sf), rows)


def test_few_dimensions_and_degenerate_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    check(whiten(make(vectors(20, 2))), vectors(20, 2))
    assert whiten(make([])).count() == 0
    assert whiten(make([(1, None, "", ""), (2, [], "", "")])).count() == 0
    one = whiten(make([(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    line = whiten(make([(i, [float(i), 2.0 * i, 0.0], "", "") for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in line)


def test_huge_entries(spark):
    rows = [(1, [1e300, 0.0], "", ""), (2, [-1e300, 1.0], "", ""), (3, [0.0, 0.5], "", "")]
    out = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6 and all(r.deviation is None for r in out if r.vec_id < 3)


def test_merge_equals_one_block():
    rng = random.Random(4)
    v = np.array([[rng.randint(-10**6, 10**6) + 10**7 for _ in range(5)] for _ in range(500)])
    parts = [W.moments(p) for p in (v[:1], v[1:40], v[40:], )]
    got, whole = W.merged(W.merged(parts[0], parts[1]), parts[2]), W.moments(v)
    assert got.n == 500 and got.sums == whole.sums
    assert np.allclose(got.scatter, whole.scatter, rtol=1e-12) and np.allclose(got.mean, whole.mean, rtol=1e-14)


def test_packing_of_vectors():
    for x in ([0, 0], [1, -1, 0], [127, -128], [128], [-(2**15)], [2**31], [2**63 - 1, -(2**63)]):
        a = np.array(x, np.int64)
        assert W.unpacked(W.packed(a), len(x)).tolist() == x
