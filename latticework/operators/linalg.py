"""Small matrices: builders for the driver, closed forms for columns, batches in vectorised functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def from_column_major(values, dims: int) -> np.ndarray:
    """Matrix of values that stand column after column."""
    return np.asarray(values).reshape(dims, dims).T.copy()


def rows_of_column_major(values: Column, dims: int) -> Column:
    """An array column that has ``dims`` x ``dims`` values column after column, as one that has them row after row."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims * dims - 1)), lambda k: F.element_at(values, (k % dims * dims + F.floor(k / dims) + 1).cast("int")))


def scale(*s: float) -> np.ndarray:
    return np.diag([*map(float, s), 1.0])


def translate(*t: float) -> np.ndarray:
    m = np.eye(len(t) + 1)
    m[:-1, -1] = t
    return m


def rotate(dims: int, a: int, b: int, angle: float) -> np.ndarray:
    """Rotation in the plane of axes a and b, homogeneous."""
    m = np.eye(dims + 1)
    c, s = np.cos(angle), np.sin(angle)
    m[a, a], m[a, b], m[b, a], m[b, b] = c, -s, s, c
    return m


def shear(dims: int, a: int, b: int, amount: float) -> np.ndarray:
    m = np.eye(dims + 1)
    m[a, b] = amount
    return m


def perspective(dims: int, axis: int, distance: float) -> np.ndarray:
    m = np.eye(dims + 1)
    m[-1, axis] = 1 / distance
    return m


def orthographic(dims: int, axis: int) -> np.ndarray:
    m = np.eye(dims + 1)
    m[axis, axis] = 0
    return m


def transform_point(m: np.ndarray, p) -> np.ndarray:
    h = np.asarray(m, float) @ np.append(np.asarray(p, float), 1.0)
    return h[:-1] / h[-1]


def parallel_view(angle: float, detectors: int, extent) -> np.ndarray:
    """2 x 3 projection of the plane to a detector line through the middle, at an angle."""
    c = (np.array(extent, float) - 1) / 2
    d = np.array([np.cos(angle), np.sin(angle)])
    return np.array([[d[0], d[1], (detectors - 1) / 2 - d @ c], [0, 0, 1.0]])


def cone_view(angle: float, source: float, detector: float, size, extent) -> np.ndarray:
    """3 x 4 projection from a source that turns about axis 2 to a flat detector of ``size``."""
    c = (np.array(extent, float) - 1) / 2
    u, w = np.array([-np.sin(angle), np.cos(angle), 0]), np.array([np.cos(angle), np.sin(angle), 0])
    v = np.array([0, 0, 1.0])
    mid = (np.array(size, float) - 1) / 2
    rows = np.array([(source + detector) * u + mid[0] * w, (source + detector) * v + mid[1] * w, w])
    shift = np.array([mid[0] * source, mid[1] * source, source]) - rows @ c
    return np.hstack([rows, shift[:, None]])


def camera_centre(m: np.ndarray) -> tuple[np.ndarray, bool]:
    """Centre of a projection and whether it is at infinity (then its direction)."""
    h = np.linalg.svd(np.asarray(m, float))[2][-1]
    far = abs(h[-1]) < 1e-9 * np.linalg.norm(h)
    return (h[:-1] / np.linalg.norm(h[:-1]), True) if far else (h[:-1] / h[-1], False)


def solve2(a11: Column, a12: Column, a21: Column, a22: Column, b1: Column, b2: Column) -> tuple[Column, Column]:
    """Solution of a 2 x 2 system; null if a pivot is under 1e-10."""
    det = a11 * a22 - a12 * a21
    pivot = F.greatest(F.abs(a11), F.abs(a21))
    fine = (pivot >= 1e-10) & (F.abs(det) >= 1e-10 * pivot)
    return F.when(fine, (b1 * a22 - a12 * b2) / det), F.when(fine, (a11 * b2 - a21 * b1) / det)


def determinant(m: Column, n: int) -> Column:
    """Of an n x n matrix in an array column, by rows; closed forms up to 3."""
    at = lambda r, c: m[r * n + c]
    if n == 1:
        return m[0]
    if n == 2:
        return at(0, 0) * at(1, 1) - at(0, 1) * at(1, 0)
    if n == 3:
        minor = lambda a, b: at(1, a) * at(2, b) - at(1, b) * at(2, a)
        return at(0, 0) * minor(1, 2) - at(0, 1) * minor(0, 2) + at(0, 2) * minor(0, 1)
    return _batch("double", lambda x: np.linalg.det(x), n)(m)


def _batch(kind: str, solve, n: int):
    @F.pandas_udf(kind)
    def run(m: pd.Series) -> pd.Series:
        x = np.stack(m.to_numpy()).reshape(-1, n, n) if len(m) else np.empty((0, n, n))
        y = solve(x)
        return pd.Series(y if y.ndim == 1 else list(y.reshape(len(x), -1)))

    return run


def inverse(m: Column, n: int) -> Column:
    """Inverse by rows; null entries for a singular matrix."""

    def solve(x: np.ndarray) -> np.ndarray:
        good = np.abs(np.linalg.det(x)) > 0
        y = np.full(x.shape, np.nan)
        y[good] = np.linalg.inv(x[good])
        return y

    return _batch("array<double>", solve, n)(m)


def singular_values(m: Column, n: int) -> Column:
    return _batch("array<double>", lambda x: np.linalg.svd(x, compute_uv=False), n)(m)


def eigenvalues(m: Column, n: int) -> Column:
    """Of symmetric matrices, falling."""
    return _batch("array<double>", lambda x: np.linalg.eigvalsh(x)[:, ::-1].copy(), n)(m)


def signed(vectors: np.ndarray) -> np.ndarray:
    """1 or -1 for each column of each matrix, so that its largest entry by size (the first of several) becomes positive."""
    at = np.argmax(np.round(np.abs(vectors), 12), axis=1)
    return np.where(np.take_along_axis(vectors, at[:, None, :], 1)[:, 0, :] < 0, -1.0, 1.0)


def _matrices(m: pd.Series, n: int) -> np.ndarray:
    return np.stack(m.to_numpy()).astype(float).reshape(-1, n, n) if len(m) else np.empty((0, n, n))


def _filled(some: np.ndarray, values: np.ndarray) -> pd.Series:
    """``values`` where ``some`` is true, null elsewhere; of more than one axis as lists."""
    found = iter(values if values.ndim == 1 else values.reshape(len(values), -1).tolist())
    return pd.Series([next(found) if s else None for s in some], dtype=object)


def decomposition(m: Column, n: int) -> Column:
    """Singular value decomposition u diag(s) v' of n x n matrices: a struct of u, s (falling), v, rank, cond (infinite if singular) and norm.

    Columns of v point so that their largest entry is positive. The rank counts values over n times the rounding of the largest one. Null matrices are null.
    """

    @F.pandas_udf("u array<double>, s array<double>, v array<double>, rank int, cond double, norm double")
    def run(given: pd.Series) -> pd.DataFrame:
        some = given.notna().to_numpy()
        u, s, vt = np.linalg.svd(_matrices(given[some], n))
        sign = signed(vt.transpose(0, 2, 1))
        u, v = u * sign[:, None, :], vt.transpose(0, 2, 1) * sign[:, None, :]
        rank = (s > n * np.finfo(float).eps * s[:, :1]).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cond = np.where(s[:, -1] > 0, s[:, 0] / s[:, -1], np.inf)
        return pd.DataFrame({k: _filled(some, x) for k, x in {"u": u, "s": s, "v": v, "rank": rank, "cond": cond, "norm": s[:, 0]}.items()})

    return run(m)


def eigen(m: Column, n: int) -> Column:
    """Eigenvalues (falling) and orthonormal eigenvectors, as columns, of symmetric n x n matrices: a struct of values and vectors, signs as in ``decomposition``."""

    @F.pandas_udf("values array<double>, vectors array<double>")
    def run(given: pd.Series) -> pd.DataFrame:
        some = given.notna().to_numpy()
        values, vectors = np.linalg.eigh(_matrices(given[some], n))
        values, vectors = values[:, ::-1], vectors[:, :, ::-1]
        vectors = vectors * signed(vectors)[:, None, :]
        return pd.DataFrame({"values": _filled(some, values), "vectors": _filled(some, vectors)})

    return run(m)


def eliminated(a: np.ndarray, b: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Solutions of a batch of systems by elimination with row pivots; NaN where a pivot is under ``least``."""
    rows, n = np.concatenate([a, b[:, :, None]], 2), a.shape[1]
    fine, each = np.ones(len(a), bool), np.arange(len(a))
    for k in range(n):
        best = k + np.abs(rows[:, k:, k]).argmax(1)
        rows[each, k], rows[each, best] = rows[each, best].copy(), rows[each, k].copy()
        pivot = rows[:, k, k]
        fine &= np.abs(pivot) >= least
        rows[:, k] /= np.where(np.abs(pivot) >= least, pivot, 1.0)[:, None]
        for r in range(n):
            if r != k:
                rows[:, r] -= rows[:, r, k, None] * rows[:, k]
    out = rows[:, :, n]
    out[~fine] = np.nan
    return out


def solve(a: Column, b: Column, n: int) -> Column:
    """Solutions of n x n systems in array columns (a by rows): an array, null for a singular system."""

    @F.pandas_udf("array<double>")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        some = (left.notna() & right.notna()).to_numpy()
        if not some.any():
            return pd.Series([None] * len(left), dtype=object)
        x = eliminated(_matrices(left[some], n), np.stack(right[some].to_numpy()).astype(float))
        return _filled(some, x).map(lambda r: None if r is None or np.isnan(r).any() else r)

    return run(a, b)


def project_point(m: Column, point: list[Column]) -> list[Column]:
    """The place on the detector where a projection (an array column, by rows, of D rows and D + 1 columns) puts a point, divided by its depth."""
    deep = projected_line(m, point, len(point) - 1)
    return [projected_line(m, point, r) / deep for r in range(len(point) - 1)]


def projected_line(m: Column, point: list[Column], row: int) -> Column:
    """A row of a projection times a point."""
    d = len(point)
    return sum((m[row * (d + 1) + k] * c for k, c in enumerate(point)), m[row * (d + 1) + d])


def projection_slopes(m: Column, point: list[Column]) -> list[list[Column]]:
    """How the place on the detector moves with the point: a row for each axis of the detector."""
    d = len(point)
    deep, place = projected_line(m, point, d - 1), project_point(m, point)
    return [[(m[r * (d + 1) + k] - place[r] * m[(d - 1) * (d + 1) + k]) / deep for k in range(d)] for r in range(d - 1)]


def product_of(a: Column, b: Column, n: int) -> Column:
    """Product of two n x n matrices in array columns, as column arithmetic."""
    return F.array(*[sum((a[r * n + k] * b[k * n + c] for k in range(1, n)), a[r * n] * b[c]) for r in range(n) for c in range(n)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
