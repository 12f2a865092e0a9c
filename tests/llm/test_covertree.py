import numpy as np
import pytest

from isospan.llm import covertree
from isospan.llm.covertree import QUERY_LEAF, Best, CoverTree, search, top_k

BIG = 10**6


def brute(rows, queries, k=5):
    """(query_id, rank, vec_id, score) of every query row; queries are places in rows."""
    usable = [(n, i, [int(c) for c in np.floor(256 * np.array(v, float))]) for n, (i, v) in enumerate(rows) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for n, i, v in usable:
        if n in queries:
            found = sorted((-sum(a * b for a, b in zip(v, w)), BIG if j is None else j) for m, j, w in usable if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, None if j == BIG else j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out, key=str)


def run(spark, rows, queries, k=5):
    schema = "vec_id long, embedding array<double>"
    asked = spark.createDataFrame([rows[n] for n in sorted(queries)], schema)
    return sorted((tuple(r) for r in top_k(spark.createDataFrame(rows, schema), asked, k=k).collect()), key=str)


def clustered(rng, n, dim, clusters, spread):
    centers = rng.normal(size=(clusters, dim))
    centers *= 256 / np.linalg.norm(centers, axis=1, keepdims=True)
    return np.floor(centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * spread)


def test_tree_covers_its_points():
    x = np.random.default_rng(1).normal(size=(700, 8))
    x[300:500] = x[3]
    tree = CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(700))
    for n, (c, r, angle, top, (lo, hi)) in enumerate(zip(tree.center, tree.radius, tree.angle, tree.top, tree.span)):
        own = x[tree.order[lo:hi]]
        assert np.sqrt(((own - x[c]) ** 2).sum(1)).max() <= r + 1e-9 and c in tree.order[lo:hi]
        norms = np.linalg.norm(own, axis=1)
        assert norms.max() <= top + 1e-9
        assert np.arccos(np.clip(own @ x[c] / norms / np.linalg.norm(x[c]), -1, 1)).max() <= angle + 1e-6
        if tree.inner[n]:
            assert sum(tree.span[k][1] - tree.span[k][0] for k in tree.kids(n)) == hi - lo


def test_bounds_hold():
    rng = np.random.default_rng(5)
    q, r = CoverTree(np.floor(rng.normal(size=(90, 4)) * 50)), CoverTree(np.floor(clustered(rng, 400, 4, 7, 20)))
    bound, every = q.balls().bounds(r.balls()), q.x @ r.x.T
    for a in range(len(q.center)):
        for b in range(len(r.center)):
            assert every[np.ix_(q.order[slice(*q.span[a])], r.order[slice(*r.span[b])])].max() <= bound[a, b]


@pytest.mark.parametrize("dim, clusters, most", [(8, 200, 0.02), (16, 200, 0.02), (64, 200, 0.02)])
def test_search_prunes_clustered_vectors_and_stays_exact(dim, clusters, most):
    """50,000 vectors, 500 queries, default leaves: the share of products made is below `most`."""
    x = clustered(np.random.default_rng(dim), 50_000, dim, clusters, 3)
    ids, asked = np.arange(50_000), np.arange(0, 50_000, 100)
    queries, best = CoverTree(x[asked], leaf=QUERY_LEAF), Best(500, 6)
    assert queries.inner[0] and queries.inner[queries.kids(0)].any()  # deeper than one level
    made = 0
    for at in range(0, len(x), 10_000):
        part = slice(at, at + 10_000)
        met, n = search(queries, ids[asked], CoverTree(x[part], ids[part]), ids[part], best)
        made += n
    assert made < most * 500 * 50_000
    s = (x[asked] @ x.T).astype(np.int64)
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :6]
    assert (want == best.id).all()
    assert ((best.id == ids[asked][:, None]) == best.own).all()


def test_floor_leaves_out_what_cannot_count():
    x = clustered(np.random.default_rng(9), 5000, 8, 40, 3)
    ids, floor = np.arange(5000), np.full(1, 2**40)
    assert search(CoverTree(x[:1]), ids[:1], CoverTree(x), ids, Best(1, 6, floor)) == (1, 0)


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # ties within leaves
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (None, [1.0] * 6), (405, [1.0, 2.0]), (406, [3.0, -1.0])]
    rows += [(0, rows[9][1]), (7, rows[7][1]), (14, rows[14][1]), (500, [0.0] * 6), (501, [0.0] * 6)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"CELL_BYTES": 2000, "PART_BYTES": 1500, "TREE_BYTES": 700, "BLOCK_BYTES": 600, "HELD_BLOCKS": 1}])
def test_brute_force_with_odd_vectors(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(covertree, name, value)
    rows = odd_rows()
    queries = {n for n, (i, _) in enumerate(rows) if i is not None and (i % 7 == 0 or i in (404, 405, 501))}
    assert run(spark, rows, queries) == brute(rows, queries)
    assert run(spark, rows, queries, k=70) == brute(rows, queries, k=70)


def test_repeated_ids_are_answered_one_by_one(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (3, [2.0, 0.0]), (None, [0.5, 0.5])]
    assert run(spark, rows, {0, 1, 2}) == brute(rows, {0, 1, 2})


def test_large_components_are_exact(spark):
    rows = [(1, [2.0**20, 1.0]), (2, [2.0**20, 3.0]), (3, [2.0**20 + 1, -1.0])]
    assert run(spark, rows, {0, 1, 2}) == brute(rows, {0, 1, 2})
    with pytest.raises(Exception, match="BIGINT"):
        run(spark, [(1, [2.0**30]), (2, [2.0**30])], {0})


def test_few_rows_empty_and_clashing_columns(spark):
    assert run(spark, [(1, [1.0]), (2, [2.0])], {0}) == [(1, 1, 2, 256 * 512)]
    assert run(spark, [(1, [1.0])], {0}) == [] and run(spark, [], set()) == []
    df = spark.createDataFrame([(1, [1.0], 9, 9, "x", 9), (2, [2.0], 9, 9, "x", 9)], "vec_id long, embedding array<float>, part int, key int, floor string, rank int")
    assert [tuple(r) for r in top_k(df, df.where("vec_id = 1")).collect()] == [(1, 1, 2, 256 * 512)]


def test_null_rows_only(spark):
    df = spark.createDataFrame([(None, None), (50, None)], "vec_id long, embedding array<float>")
    assert top_k(df, df).collect() == []
