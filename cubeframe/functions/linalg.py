"""Small dense algebra on the driver over sums that Spark has made: band by band, never sample by sample."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length and without nulls."""
    offsets = column.offsets.to_numpy()
    width = np.unique(np.diff(offsets))
    if column.null_count or len(width) != 1:
        raise ValueError("the arrays of a matrix are all of one length, none is null")
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(float).reshape(-1, width[0])


def gram(rows: DataFrame, arrays: list[str], keys: list[str] | None = None) -> dict[tuple, tuple[float, np.ndarray]]:
    """{key: (n, Z'Z)} with Z = [1, arrays side by side], over rows of equal array lengths; others raise ValueError.

    Every task adds up its rows into one packed matrix per key, the tasks' matrices of a key are added up in two steps, and one
    row per key reaches the driver. Keys must be few (folds, classes, subsets): they and the bands bound what that is.
    """
    keys = keys or []
    names = [f"k{n}" for n in range(len(keys))]
    schema = "".join(f"{n} string, " for n in names) + "part int, size int, m binary"

    def rows_of(sums: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, m in sums.items():
            part = TaskContext.get().partitionId() % 16  # of a key's matrices, those of one part are added first
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.string()) for v in k), pa.array([part], pa.int32()), pa.array([len(m)], pa.int32()), pa.array([m.tobytes()])], names=[*names, "part", "size", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.hstack([np.ones((batch.num_rows, 1)), *(_matrix(batch.column(c)) for c in arrays)])
            code, of = np.zeros(batch.num_rows, np.int64), [()]
            for k in keys:
                d = batch.column(k).cast(pa.string()).dictionary_encode(null_encoding="encode")
                code = code * len(d.dictionary) + d.indices.to_numpy()
                of = [(*x, v) for x in of for v in d.dictionary.to_pylist()]
            for c in np.unique(code):
                x = z[code == c]
                sums[of[c]] = sums.get(of[c], 0) + x.T @ x
        yield from rows_of(sums)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                k = tuple(row[n] for n in names)
                sums[k] = sums.get(k, 0) + np.frombuffer(row["m"]).reshape(row["size"], -1)
        yield from rows_of(sums)

    parts = rows.select(*keys, *arrays).mapInArrow(add, schema).repartition(*names, "part").mapInArrow(together, schema)
    total = parts.repartition(*names).mapInArrow(together, schema) if names else parts.coalesce(1).mapInArrow(together, schema)
    matrices = {tuple(r[n] for n in names): np.frombuffer(r["m"]).reshape(r["size"], -1).copy() for r in total.collect()}
    return {k: (m[0, 0], m) for k, m in matrices.items()}


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, sums of squares and products about the means) of the columns after the first."""
    n, s = m[0, 0], m[0, 1:]
    return s / n, m[1:, 1:] - np.outer(s, s) / n


def pls(xx: np.ndarray, xy: np.ndarray, components: int, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(B, R): coefficients and rotations by the improved kernel algorithm (Dayal and MacGregor 1997), from X'X and X'Y."""
    xy = xy.copy()
    ws, ps, qs, rs = [], [], [], []
    for _ in range(components):
        if np.abs(xy).max(initial=0) < tolerance:
            break
        if xy.shape[1] == 1:
            w = xy[:, 0]
        else:
            _, vec = np.linalg.eigh(xy.T @ xy)
            w = xy @ vec[:, -1]
        w = w / np.linalg.norm(w)
        r = w.copy()
        for p, old in zip(ps, rs):
            r -= (p @ w) * old
        tt = r @ xx @ r
        p, q = xx @ r / tt, xy.T @ r / tt
        xy -= tt * np.outer(p, q)
        ws.append(w), ps.append(p), qs.append(q), rs.append(r)
    rotation = np.array(rs).T if rs else np.zeros((len(xx), 0))
    return rotation @ np.array(qs).reshape(len(rs), -1), rotation


def chi2_quantile(p: float, k: float) -> float:
    """Inverse of the chi-squared distribution, by bisection of the lower regularised gamma series."""

    def cdf(x: float) -> float:
        a, x = k / 2, x / 2
        if x <= 0:
            return 0.0
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    low, high = 0.0, max(k, 1.0)
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def savgol_matrix(n: int, window: int, order: int, deriv: int = 0) -> np.ndarray:
    """The n x n matrix of a Savitzky-Golay filter with unit steps; the ends use the polynomials of the outer windows."""
    if window % 2 == 0 or window <= order or window > n:
        raise ValueError("the window is odd, above the order and at most the length")
    half = window // 2
    at = np.arange(-half, half + 1, dtype=float)
    fit = np.linalg.pinv(np.vander(at, order + 1, increasing=True))

    def row(offset: float) -> np.ndarray:
        power = np.array([math.perm(i, deriv) * offset ** (i - deriv) if i >= deriv else 0.0 for i in range(order + 1)])
        return power @ fit

    m = np.zeros((n, n))
    for i in range(n):
        first = min(max(i - half, 0), n - window)
        m[i, first : first + window] = row(i - first - half)
    return m
