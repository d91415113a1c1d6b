"""Interpolation at points, its adjoint, and resampling by a coordinate map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import fold
from ..grid import Grid, at_cells, lattice
from .prefix import box_means, integral

WIDTH = {"nearest": 1, "linear": 2, "quadratic": 3, "cubic": 4}


def half_away(x: Column) -> Column:
    """Rounded, halves away from zero."""
    return F.round(x).cast("int")


def taps(x: Column, kind: str) -> tuple[Column, list[Column]]:
    """First index and weights of a one-dimensional interpolator: linear, or B-splines that smooth."""
    if kind == "nearest":
        return half_away(x), [F.lit(1.0)]
    if kind == "linear":
        base = F.floor(x).cast("int")
        return base, [1 - (x - base), x - base]
    if kind == "quadratic":
        mid = half_away(x)
        t = x - mid
        return mid - 1, [0.5 * (0.5 - t) * (0.5 - t), 0.75 - t * t, 0.5 * (0.5 + t) * (0.5 + t)]
    if kind == "cubic":
        base = F.floor(x).cast("int")
        t = x - base
        u = 1 - t
        return base - 1, [u * u * u / 6, (4 - 6 * t * t + 3 * t * t * t) / 6, (4 - 6 * u * u + 3 * u * u * u) / 6, t * t * t / 6]
    raise ValueError(f"unknown interpolator {kind}")


def tapped(points: DataFrame, extent, kind: str, border: str) -> DataFrame:
    """Points (c0, c1, ...) with one row per tap: axis columns i0, ... and weight w; zero weights are left out."""
    rows = points.withColumn("w", F.lit(1.0))
    for k, n in enumerate(extent):
        base, weights = taps(F.col(f"c{k}").cast("double"), kind)
        tap = F.array(*[F.struct(fold(base + j, n, border).cast("int").alias("i"), w.alias("w")) for j, w in enumerate(weights)])
        rows = rows.withColumn("t", F.explode(tap)).withColumn(f"i{k}", F.col("t.i")).withColumn("w", F.col("w") * F.col("t.w")).drop("t")
    return rows.where("w <> 0")


def sample(g: Grid, points: DataFrame, kind: str = "linear", border: str = "clamp", name: str = "point") -> DataFrame:
    """Values at points (columns ``name``, c0, c1, ...)."""
    cells = g.df.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(g.axes)], F.col(g.value).alias("x"))
    rows = at_cells(tapped(points, g.extent, kind, border), g, cells, [f"i{k}" for k in range(g.dims)])
    return rows.groupBy(name).agg(F.sum(F.col("w") * F.col("x")).alias("v"))


def scatter_add(points: DataFrame, extent, kind: str = "linear", border: str = "clamp", value: str = "v") -> Grid:
    """The adjoint of ``sample``: values of points spread over the cells they are read from. The dense grid comes out."""
    axes = tuple(f"i{k}" for k in range(len(extent)))
    rows = tapped(points, extent, kind, border).groupBy(*axes).agg(F.sum(F.col("w") * F.col(value)).alias("v"))
    return Grid(rows, axes, tuple(extent)).filled(0.0)


def mapped_points(axes, matrix: np.ndarray) -> list[Column]:
    """Homogeneous map of axis columns, with the perspective divide if the last row needs it."""
    m = np.asarray(matrix, float)
    line = lambda r: sum((F.col(a) * F.lit(float(r[k])) for k, a in enumerate(axes)), F.lit(float(r[-1])))
    scale = None if (m[-1, :-1] == 0).all() and m[-1, -1] == 1 else line(m[-1])
    return [line(r) if scale is None else line(r) / scale for r in m[:-1]]


def jacobian(matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Derivative of a homogeneous map at a point."""
    m = np.asarray(matrix, float)
    d = len(m) - 1
    h = m @ np.append(at, 1.0)
    return (m[:d, :d] * h[d] - np.outer(h[:d], m[d, :d])) / h[d] ** 2


def resample(g: Grid, extent, matrix, kind: str = "linear", antialias: bool = True, border: str = "clamp") -> Grid:
    """A grid of ``extent`` read from ``g`` through a map of its coordinates.

    If the map shrinks (a half width over 0.5 at the centre of the output), box means are read from a
    summed-area table instead.
    """
    m = np.asarray(matrix, float)
    axes = tuple(f"i{k}" for k in range(len(extent)))
    cells = lattice(g.df.sparkSession, extent, axes)
    place = sum((F.col(a).cast("long") * F.lit(s) for a, s in zip(axes, Grid(cells.withColumn("v", F.lit(0)), axes, tuple(extent)).stride, strict=True)), F.lit(0))
    points = cells.select(place.alias("box"), *[c.alias(f"c{k}") for k, c in enumerate(mapped_points(axes, m))])
    reach = np.abs(jacobian(m, np.array(extent) / 2)).sum(1) / 2
    if antialias and (reach > 0.5).any():
        got = box_means(integral(g.mapped(lambda v: v.cast("double"))), points, reach.tolist()).withColumnRenamed("mean", "v")
    else:
        got = sample(g, points, kind, border, "box")
    n, cols = 1, []
    for a, e in zip(axes, extent, strict=True):
        cols.append(F.expr(f"cast((box div {n}) % {e} as int)").alias(a))
        n *= e
    return Grid(got.select(*cols, "v"), axes, tuple(extent))
