"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are both indexed. A node keeps one of its points as center,
its covering radius, the widest angle and largest norm of its points, and
children that cover it at a smaller scale. The best product a pair of nodes can
hold is bounded by the centers' product and both covering radii, and again by
norms and angles; a pair is dropped once that is below the worst k-th score of
the query node's group.

1. Centers of a cover tree over a bounded sample cut space into cells. Rows are
   dealt to parts of one cell, queries to blocks of one cell; a large cell is
   dealt over several of either.
2. Queries meet the rows of their own cell. The k-th scores found there are
   floors for all that follows.
3. Every part meets the blocks of the other cells, dropping whole blocks, then
   node pairs, by those floors.

A part is read once a round, whatever the number of queries: blocks lie in the
shared folder with their trees built, and a task opens one at a time.
"""

from __future__ import annotations

import pickle
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, open_store, pieces_of, shared_dir

K = 5
SCALE = 1.3  # ratio of the radii of two levels
FAN = 16
LEAF = 16
QUERY_LEAF = 4  # small, as the least of a group's k-th scores counts
FIRST_LEAVES = 8  # met by a query group before its k-th scores are looked at again
SAMPLE_BYTES = 4_000_000  # of vectors sampled to lay cells
MOST_CELLS = 1024
CELL_BYTES = 2_000_000
PART_BYTES = 64_000_000  # of vectors held by a task
TREE_BYTES = 8_000_000  # of vectors under one data tree
BLOCK_BYTES = 2_000_000  # of vectors in a query block
HELD_BLOCKS = 8
NO_ID = 2**63 - 1  # stands for a null id, which ranks after every other
NONE = -(2**63) + 1  # below every score
_ANGLE = 1e-6


class CoverTree:
    """A batch-built cover tree over the rows of x.

    A level splits a node's points among centers taken farthest-first until all
    are within 1/SCALE of its radius, or FAN centers are reached; every node
    keeps its true covering radius. Points of a node are consecutive in order,
    those of a node of equal points by ascending id.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray | None = None, leaf: int = LEAF, fan: int = FAN):
        self.x, norm = x, np.sqrt((x * x).sum(axis=1))
        center, radius, angle, top, above, span = [], [], [], [], [], []
        self.order = order = np.arange(len(x))
        todo = [(0, len(x), 0, -1)] if len(x) else []
        while todo:
            lo, hi, middle, parent = todo.pop()
            own = order[lo:hi]
            sub, middle_norm = x[own], norm[middle]
            dist = np.sqrt(((sub - x[middle]) ** 2).sum(axis=1))
            least = norm[own].min()
            cos = (sub @ x[middle] / (norm[own] * middle_norm)).min() if least > 0 and middle_norm > 0 else -1.0
            node, r = len(center), float(dist.max())
            for column, value in zip((center, radius, angle, top, above, span), (middle, r, np.arccos(np.clip(cos, -1, 1)), norm[own].max(), parent, (lo, hi))):
                column.append(value)
            if r == 0 and ids is not None:
                order[lo:hi] = own[np.argsort(ids[own], kind="stable")]
            if hi - lo <= leaf or r == 0:
                continue
            centers, nearest = [middle], np.zeros(hi - lo, np.int64)
            while len(centers) < fan and dist.max() > r / SCALE:
                far = int(dist.argmax())
                new = np.sqrt(((sub - sub[far]) ** 2).sum(axis=1))
                closer = new < dist
                nearest[closer], dist[closer] = len(centers), new[closer]
                centers.append(int(own[far]))
            order[lo:hi] = own[np.argsort(nearest, kind="stable")]
            ends = lo + np.cumsum(np.bincount(nearest, minlength=len(centers)))
            todo += [(a, b, c, node) for c, a, b in zip(centers, [lo, *ends[:-1].tolist()], ends.tolist())]
        self.center, self.radius, self.angle, self.top = np.array(center, np.int64), np.array(radius), np.array(angle), np.array(top)
        self.span, above = np.array(span, np.int64).reshape(-1, 2), np.array(above, np.int64)
        self.kid = np.argsort(above, kind="stable")[1:]  # nodes by parent; the root has none
        self.kid_at = np.concatenate(([0], np.cumsum(np.bincount(above[1:], minlength=len(above)))))
        self.inner = np.diff(self.kid_at) > 0

    def kids(self, node: int) -> np.ndarray:
        return self.kid[self.kid_at[node] : self.kid_at[node + 1]]

    def balls(self, nodes=slice(None)) -> Balls:
        c = self.x[self.center[nodes]]
        return Balls(c, np.sqrt((c * c).sum(axis=1)), self.radius[nodes], self.angle[nodes], self.top[nodes])


@dataclass
class Balls:
    """What bounds the products of some nodes: centers, radii, angles, norms."""

    center: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    top: np.ndarray

    def bounds(self, other: Balls) -> np.ndarray:
        """Most that a product of points of a node here and one of other can be."""
        dot, norms = self.center @ other.center.T, np.outer(self.norm, other.norm)
        reach = np.outer(self.norm + self.radius, other.norm + other.radius)
        ball = dot + (reach - norms)
        with np.errstate(invalid="ignore", divide="ignore"):
            apart = np.arccos(np.clip(np.where(norms > 0, dot / norms, 1.0), -1, 1))
        apart = np.clip(apart - self.angle[:, None] - other.angle - _ANGLE, 0, np.pi / 2)
        return np.minimum(ball, np.outer(self.top, other.top) * np.cos(apart)) + 1e-9 * reach + 1e-6


class Best:
    """The best k (score, id) of each query so far, ties to the smaller id.

    floor: a score that k rows are known to reach; less is of no use.
    """

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, NONE) if floor is None else floor
        self.score, self.id, self.own = np.full((n, k), NONE), np.full((n, k), NO_ID), np.zeros((n, k), bool)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        good = scores >= self.worst(rows)[:, None]
        some, cols = good.any(axis=1), np.flatnonzero(good.any(axis=0))
        if not len(cols):
            return
        rows, scores, ids, own = rows[some], np.where(good, scores, NONE)[some][:, cols], ids[cols], own[some][:, cols]
        every = np.concatenate((self.score[rows], scores), axis=1)
        names = np.concatenate((self.id[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        owned = np.concatenate((self.own[rows], own), axis=1)
        order = np.lexsort((names, -every), axis=1)[:, : self.k]
        self.score[rows], self.id[rows], self.own[rows] = (np.take_along_axis(a, order, 1) for a in (every, names, owned))


def products(q: np.ndarray, r: np.ndarray, exact: bool = True) -> np.ndarray:
    """Integer inner products; `exact` says that doubles hold them."""
    if exact:
        return np.rint(q @ r.T).astype(np.int64)
    whole = np.array([[int(c) for c in v] for v in q], object) @ np.array([[int(c) for c in v] for v in r], object).T
    if max(map(abs, whole.flat), default=0) >= 2**63 - 1:
        raise OverflowError("an inner product is beyond the range of BIGINT")
    return whole.astype(np.int64)


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, ids: np.ndarray, best: Best) -> tuple[int, int]:
    """Offers to best all data that can be among a query's k.

    Returns how many node pairs were met and how many products were made.
    """
    if not len(data.center) or not len(queries.center):
        return 0, 0
    met = made = 0
    bound = queries.balls().bounds(data.balls())
    exact = queries.top[0] * data.top[0] < 2**53
    size = data.span[:, 1] - data.span[:, 0]
    size = np.where(data.radius == 0, np.minimum(size, best.k), size)  # of equal vectors the smallest ids do

    def below(nodes):
        return data.kid[_ranges(data.kid_at[nodes], data.kid_at[nodes + 1])]

    todo = [(0, np.array([0]))]
    while todo:
        a, nodes = todo.pop()
        group, near = queries.order[slice(*queries.span[a])], bound[a]
        worst = best.worst(group).min()
        met += len(nodes)
        nodes = nodes[near[nodes] >= worst]
        if queries.inner[a]:
            wide = data.inner[nodes] & (data.radius[nodes] >= queries.radius[a])
            nodes = np.concatenate([nodes[~wide], below(nodes[wide])])
            todo += [(kid, nodes) for kid in queries.kids(a)]
            continue
        leaves = []
        while len(nodes):
            leaves.append(nodes[~data.inner[nodes]])
            nodes = below(nodes[data.inner[nodes]])
            met += len(nodes)
            nodes = nodes[near[nodes] >= worst]
        leaves = np.concatenate([nodes, *leaves])
        leaves = leaves[np.argsort(-near[leaves], kind="stable")]
        at, take = 0, FIRST_LEAVES
        while at < len(leaves) and near[leaves[at]] >= worst:  # the best bounds are met first
            now = leaves[at : at + take]
            now = now[near[now] >= worst]
            at, take = at + take, 4 * take
            cols = data.order[_ranges(data.span[now, 0], data.span[now, 0] + size[now])]
            own = query_ids[group][:, None] == ids[cols]
            for i, j in zip(*np.nonzero(own)):
                own[i, j] = np.array_equal(queries.x[group[i]], data.x[cols[j]])
            best.offer(group, products(queries.x[group], data.x[cols], exact), ids[cols], own)
            made += len(group) * len(cols)
            worst = best.worst(group).min()
    return met, made


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, end), range after range."""
    n = ends - starts
    return np.arange(int(n.sum())) + np.repeat(starts - np.cumsum(n) + n, n)


# -- rows, cells, parts and blocks ---------------------------------------------


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 * x) of every component, as double.

    Left out: null or empty vectors and those with a null or non-finite
    component. A null id is NO_ID.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0").where(fine)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))


def _by_length(lists):
    """(length, rows, matrix) of a column of vectors, one for each length."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        yield dim, own, flat[(ends[own] - dim)[:, None] + np.arange(dim)]


def _cells(rows: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """Cell centers of each vector length, from a sample of bounded size; also the bytes."""
    n, components = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    take = max(1, int(SAMPLE_BYTES * n // max(1, 8 * components)))
    by: dict[int, list] = {}
    for r in rows.select("v").orderBy(F.xxhash64("v", "vec_id")).limit(take).collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    sampled, out = sum(map(len, by.values())), {}
    for dim, own in by.items():
        cells = min(MOST_CELLS, max(1, round(8 * components / CELL_BYTES)) * len(own) // sampled + 1, len(own))
        tree = CoverTree(np.array(own), leaf=pieces_of(len(own), cells))
        leaves = np.flatnonzero(~tree.inner)
        most = leaves[np.argsort(-(tree.span[leaves, 1] - tree.span[leaves, 0]), kind="stable")][:cells]
        out[dim] = tree.x[tree.center[most]]
    return out, 8 * components


def _in_cells(rows: DataFrame, cells: dict[int, np.ndarray]) -> DataFrame:
    """rows with their vectors' length and nearest cell (0 where a length was not sampled)."""

    def dealt(batches):
        import pyarrow as pa

        half = {dim: (c, (c * c).sum(axis=1) / 2) for dim, c in cells.items()}
        for batch in batches:
            dims, cell = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for dim, own, x in _by_length(batch.column(1)):
                dims[own] = dim
                if dim in half:
                    c, least = half[dim]
                    cell[own] = (x @ c.T - least).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell)], names=["vec_id", "v", "dim", "cell"])

    return rows.mapInArrow(dealt, "vec_id long, v array<double>, dim int, cell int")


def _dealt(rows: DataFrame, each_bytes: int, name: str) -> tuple[DataFrame, int]:
    """rows with a number for their cell and, in a large one, the share of it; and how many."""
    counts = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    shares = cut(counts.select("dim", "cell", F.ceil(F.col("n") * F.col("dim") * 8 / each_bytes).cast("int").alias("_shares")))
    order = Window.orderBy("dim", "cell")  # a row per cell
    placed = shares.withColumn("_first", F.sum("_shares").over(order) - F.col("_shares"))
    number = (F.col("_first") + F.pmod(F.monotonically_increasing_id(), F.col("_shares"))).cast("int")
    total = shares.agg(F.coalesce(F.sum("_shares"), F.lit(0))).first()[0]
    return rows.join(F.broadcast(placed), ["dim", "cell"]).withColumn(name, number).drop("_shares", "_first"), int(total)


_BLOCK = "block int, dim int, cell int, floor long, center binary, radius double, angle double, top double, tree binary"


def _block(pdf):
    """A query block as one row: its root's bounds and its pickled tree."""
    import pandas as pd

    pdf = pdf.sort_values("key")
    x = np.array(pdf["v"].tolist())
    tree = CoverTree(x, leaf=QUERY_LEAF)
    root, floor = tree.balls([0]), pdf["floor"].to_numpy(np.int64)
    held = pickle.dumps((tree, pdf["key"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64), floor))
    return pd.DataFrame([[pdf["block"].iloc[0], pdf["dim"].iloc[0], pdf["cell"].iloc[0], floor.min(), root.center.tobytes(), root.radius[0], root.angle[0], root.top[0], held]], columns=[c.split()[0] for c in _BLOCK.split(", ")])


class Blocks:
    """Query blocks in the shared folder, as a task sees them."""

    def __init__(self, root: str):
        import pyarrow.parquet as pq

        self.store, folder = open_store(root)
        self.tables, self.held = {}, {}
        from pyarrow import fs

        names = [f.path for f in self.store.get_file_info(fs.FileSelector(folder)) if f.is_file and posixpath.basename(f.path).startswith("part-")]
        for name in sorted(names):
            rows = pq.read_table(name, filesystem=self.store, columns=[c.split()[0] for c in _BLOCK.split(", ")][:-1]).to_pylist()
            for group, r in enumerate(rows):
                center = np.frombuffer(r["center"])[None]
                ball = Balls(center, np.sqrt((center * center).sum(axis=1)), *(np.array([r[c]]) for c in ("radius", "angle", "top")))
                self.tables[r["block"]] = (r["dim"], r["cell"], r["floor"], ball, name, group)

    def tree(self, block: int):
        import pyarrow.parquet as pq

        if block not in self.held:
            while len(self.held) >= HELD_BLOCKS:
                self.held.pop(next(iter(self.held)))
            *_, name, row = self.tables[block]
            self.held[block] = pickle.loads(pq.read_table(name, filesystem=self.store, columns=["tree"]).column(0)[row].as_py())
        return self.held[block]


_FOUND = "key long, query_id long, vec_id long, score long, own boolean"


def _searched(root: str, k: int, home: bool):
    """Searches a part's rows for the blocks of its own cell (home), or of all others."""

    def searched(batches):
        import pyarrow as pa

        blocks, part, held, size = Blocks(root), None, [], 0

        def flush():
            nonlocal held, size
            by: dict[int, list] = {}
            for cell, ids, lists in held:
                for dim, own, x in _by_length(lists):
                    by.setdefault((dim, cell), []).append((ids[own], x))
            held, size = [], 0
            for (dim, cell), own in by.items():
                ids, x = (np.concatenate(c) for c in zip(*own))
                each = max(1, TREE_BYTES // (8 * dim))
                trees = [(CoverTree(x[at : at + each], ids[at : at + each]), ids[at : at + each]) for at in range(0, len(x), each)]
                roots = [tree.balls([0]) for tree, _ in trees]
                for block, (its_dim, its_cell, floor, ball, *_) in blocks.tables.items():
                    if its_dim != dim or (its_cell == cell) != home:
                        continue
                    near = [t for t, b in zip(trees, roots) if ball.bounds(b)[0, 0] >= floor]
                    if not near:
                        continue
                    tree, keys, query_ids, floors = blocks.tree(block)
                    best = Best(len(keys), k, floors)
                    for data, names in near:
                        search(tree, query_ids, data, names, best)
                    row, col = np.nonzero(best.score > NONE)
                    if len(row):
                        columns = (keys[row], query_ids[row], best.id[row, col], best.score[row, col], best.own[row, col])
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _FOUND.split(", ")])

        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if part != parts[a] or size >= PART_BYTES:
                    yield from flush()
                    part = parts[a]
                held.append((rows.column(1)[0].as_py(), rows.column(2).to_numpy(zero_copy_only=False), rows.column(3)))
                size += 8 * len(rows.column(3).flatten())
        yield from flush()

    return searched


def top_k(data: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k highest inner products over all other rows of data.

    Columns: query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id, a null one last; fewer than k rows give all. Vectors are floored to
    1/256; scores are exact integers, an error beyond BIGINT. A query's own row,
    one of its id and vector, is no candidate; other rows of its id, and rows
    repeated in full, are. Queries that share an id are answered one by one.
    Vectors of different lengths do not meet. Unusable vectors (see usable)
    take no part; an empty side gives no rows; other columns are ignored.
    """
    spark, each = data.sparkSession, k + 1  # one more, as the own row may be among them
    root = f"{shared_dir(spark).rstrip('/')}/top-k-{uuid.uuid4().hex}"
    rows, asked = usable(data, id_col, vec_col), usable(queries, id_col, vec_col)
    cells, total = _cells(rows)
    parts, n_parts = _dealt(_in_cells(rows, cells), PART_BYTES, "part")
    parts = cut(parts.select("part", "cell", "vec_id", "v").repartitionByRange(max(1, n_parts), "part").sortWithinPartitions("part", "cell"))
    placed, _ = _dealt(_in_cells(asked, cells), BLOCK_BYTES, "block")
    placed = cut(placed.withColumn("key", F.monotonically_increasing_id()))

    def blocks(with_floor: DataFrame, name: str) -> str:
        made = with_floor.groupBy("block").applyInPandas(_block, _BLOCK)
        made.write.option("maxRecordsPerFile", 1).parquet(f"{root}/{name}")
        return f"{root}/{name}"

    first = blocks(placed.withColumn("floor", F.lit(NONE)), "first")
    found = parts.mapInArrow(_searched(first, each, True), _FOUND)
    if max(map(len, cells.values()), default=0) > 1:  # else no query has another cell
        near = cut(found)
        kth = near.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score")))).where(F.col("_n") == each).select("key", F.col("score").alias("floor"))
        then = blocks(placed.join(kth, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE))), "then")
        found = near.union(parts.mapInArrow(_searched(then, each, False), _FOUND))
    mine = Window.partitionBy("key", "own").orderBy("score")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    others = found.withColumn("_own", F.row_number().over(mine)).where(~(F.col("own") & (F.col("_own") == 1)))
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.nullif("query_id", F.lit(NO_ID)).alias("query_id"), "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
