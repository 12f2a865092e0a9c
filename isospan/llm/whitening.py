"""Whitening of embeddings by merged moments.

Vectors become integers, and each distinct one counts once. Every task works out
count, mean and centred scatter of its vectors; Chan's formula merges these
pairwise in a tree, whose root alone, a matrix of dimensions squared, reaches the
driver for its eigenvectors. A second pass over the same vectors, merged in the
same way, verifies that the whitened ones have an identity covariance.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
COMPONENTS = 4
LEAST = 1e-12  # eigenvalues below this share of the largest are none
_LONG = 2**63


def whole_vectors(column) -> list:
    """int64 vectors floor(256 * c) of an Arrow list<double> column; None for rows
    that are null or hold null or non-finite entries.

    Values beyond a long become its bounds, as in a cast.
    """
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)  # nulls are NaN
    fine = np.isfinite(values)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * np.where(fine, values, 0.0))
    ints = np.where(scaled >= 2.0**63, _LONG - 1, np.where(scaled < -(2.0**63), -_LONG, np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
    bad = np.concatenate([[0], np.cumsum(~fine)])
    return [ints[a:b] if ok and bad[a] == bad[b] else None for a, b, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist())]


def packed(x: np.ndarray) -> bytes:
    """A vector in the narrowest integers that hold it, their width first; trailing zeros are left out."""
    used = np.flatnonzero(x)
    x = x[: used[-1] + 1] if len(used) else x[:0]
    for width in (1, 2, 4):
        small = x.astype(f"<i{width}")
        if np.array_equal(small, x):
            return bytes([width]) + small.tobytes()
    return bytes([8]) + x.astype("<i8").tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    out = np.zeros(dim, np.int64)
    own = np.frombuffer(data, f"<i{data[0]}", offset=1)
    out[: len(own)] = own
    return out


def _packed_batches(batches):
    import pyarrow as pa

    for batch in batches:
        column = batch.column(1)
        rows = [(i, packed(x), len(x)) for i, x in zip(batch.column(0).to_pylist(), whole_vectors(column)) if x is not None]
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32()))], names=["vec_id", "x", "dim"])


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x, dim): the remaining rows, vectors packed."""
    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(_packed_batches, "vec_id long, x binary, dim int")


class Moments(NamedTuple):
    """Count, mean, centred scatter, and exact sums of integer vectors."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list | None = None


def moments(v: np.ndarray, exact: bool = True) -> Moments:
    """Of the rows of v, centred before they are multiplied."""
    d = v.astype(np.float64)
    mean = d.mean(axis=0)
    d -= mean
    safe = not exact or not len(v) or max(-int(v.min()), int(v.max())) * len(v) < _LONG
    sums = None if not exact else v.sum(axis=0).tolist() if safe else [sum(map(int, c)) for c in v.T]
    return Moments(len(v), mean, d.T @ d, sums)


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise merge."""
    n = a.n + b.n
    delta = b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(delta, delta) * (a.n * b.n / n)
    sums = None if a.sums is None else [x + y for x, y in zip(a.sums, b.sums)]
    return Moments(n, a.mean + delta * (b.n / n), scatter, sums)


BATCH = 4096


def tree_moments(vectors: DataFrame, dim: int, project=None) -> Moments:
    """Moments of packed vectors (column x, one row at least), merged in a tree
    over tasks; project maps a block of them to others first."""

    def own(batches):
        import pyarrow as pa

        got = None
        for batch in batches:
            xs = batch.column(0).to_pylist()
            for at in range(0, len(xs), BATCH):
                v = np.stack([unpacked(x, dim) for x in xs[at : at + BATCH]])
                block = moments(v) if project is None else moments(project(v), False)
                got = block if got is None else merged(got, block)
        yield pa.RecordBatch.from_arrays([pa.array([] if got is None else [pickle.dumps(got)], pa.binary())], names=["m"])

    parts = vectors.select("x").mapInArrow(own, "m binary").rdd.map(lambda row: pickle.loads(row[0]))
    return parts.treeReduce(merged, max(2, (parts.getNumPartitions() - 1).bit_length() // 4))


class Whitening(NamedTuple):
    """A fitted transform: n distinct vectors, their sums, and components."""

    n: int
    sums: list
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, v: np.ndarray) -> np.ndarray:
        """Whitened rows; components without variance are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return (v.astype(np.float64) - self.mean) @ self.vectors * scale

    def deviation(self, x: np.ndarray) -> int | None:
        """Sum over dimensions of (n * x - sums) squared; None beyond a long."""
        total = sum((self.n * int(c) - s) ** 2 for c, s in zip(x, self.sums))
        return total if total < _LONG else None

    def deviations(self, v: np.ndarray) -> list:
        """deviation of each row; in whole numbers of 64 bits where those hold it."""
        top = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(v.astype(np.float64)).max(initial=0))
        if v.size and top * top * v.shape[1] < _LONG // 2:
            d = self.n * v - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        return [self.deviation(x) for x in v]


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Components of packed distinct vectors, one row at least."""
    m = tree_moments(vectors, dim)
    values, own = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(values)[::-1][:components]
    top = values[order]
    return Whitening(m.n, m.sums, np.where(top > LEAST * max(top.max(initial=0.0), 0.0), top, 0.0), own[:, order], float(np.trace(m.scatter) / m.n))


def identity_error(vectors: DataFrame, dim: int, w: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, by a second pass."""
    live = w.values > 0
    if not live.any():
        return None
    m = tree_moments(vectors, dim, lambda v: w.project(v)[:, live])
    return float(np.abs(m.scatter / m.n - np.eye(int(live.sum()))).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector, a row for each component.

    Columns: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error. Rows whose vector is null or holds null or non-finite
    entries are dropped. Vectors shorter than the longest count as filled up
    with zeros; entries beyond a long after scaling become its bounds. There are as many components as
    dimensions, `components` at most. A component without variance has explained
    0 and no whitened value; where none has, explained and identity_error are
    null. deviation is null beyond a long. Null ids and repeated rows are rows
    like others; an empty table, or one of empty vectors, gives no rows; other
    columns are ignored. Only matrices of dimensions squared leave the tasks.
    """
    spark = rows.sparkSession
    whole = integer_vectors(rows, id_col, vector_col)
    distinct = cut(whole.groupBy("x").agg(F.max("dim").alias("dim")))
    dim = distinct.agg(F.max("dim")).first()[0] or 0
    if not dim:
        return spark.createDataFrame([], _OUT)
    w = fit(distinct, dim, components)
    error = identity_error(distinct, dim, w)
    explained = [float(e) / w.trace if w.trace > 0 else None for e in w.values]
    held = spark.sparkContext.broadcast(w)

    def out(batches):
        import pyarrow as pa

        w = held.value
        k = len(w.values)
        for batch in batches:
            ids, xs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            v = np.stack([unpacked(x, dim) for x in xs]) if xs else np.zeros((0, dim), np.int64)
            got = w.project(v).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i in ids for _ in range(k)], pa.int64()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array(np.full(len(got), w.n, np.int64)),
                    pa.array([d for d in w.deviations(v) for _ in range(k)], pa.int64()),
                    pa.array(got, mask=np.isnan(got)),
                    pa.array(explained * len(ids), pa.float64()),
                    pa.array([error] * len(got), pa.float64()),
                ],
                names=[c.split()[0] for c in _OUT.split(", ")],
            )

    return whole.select("vec_id", "x").mapInArrow(out, _OUT)
