"""Stencils: weighted, smallest, largest and ranked neighbourhoods with border rules.

A cell is copied to the places where the border rule repeats it, then to every output whose kernel covers
it, and one aggregation gathers the outputs. There is no join; sums, minima and maxima are
pre-aggregated before the only shuffle. Copies per cell are as many as the kernel has taps,
so wide kernels that factor go axis by axis, and kernels of more than ``tiles.MANY_TAPS`` taps go by dense tiles.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import gaussian_weights, truncated
from ..grid import Grid
from . import tiles
from .arith import INTEGRAL
from .tiles import Kernel, padded


def box_kernel(dims: int, width: int) -> Kernel:
    return kernel_from(dict.fromkeys(product(range(width), repeat=dims), 1.0), (width,) * dims)


def cross_kernel(dims: int, width: int) -> Kernel:
    c = width // 2
    return kernel_from({k: 1.0 for k in product(range(width), repeat=dims) if sum(x != c for x in k) <= 1}, (width,) * dims)


def kernel_from(weights: Kernel, extent) -> Kernel:
    """Weights at kernel coordinates as offsets from the centre (extent // 2); zeros are left out."""
    return {tuple(x - n // 2 for x, n in zip(k, extent, strict=True)): float(w) for k, w in weights.items() if w}


def gathered(g: Grid, kernel: Kernel, border: str, **out: Column) -> DataFrame:
    """One row per cell and key; ``out`` are aggregates of the columns x (value) and w (weight) over the kernel."""
    if not kernel:
        raise ValueError("the kernel is empty")
    rows = g.df.withColumnRenamed(g.value, "x")
    now = replace(g, df=rows, value="x")
    for k in range(g.dims):
        offsets = [o[k] for o in kernel]
        rows = padded(replace(now, df=rows), k, max(0, -min(offsets)), max(0, max(offsets)), border)
        rows = rows.drop(g.axes[k]).withColumnRenamed("p", g.axes[k])
    taps = F.array(*[F.struct(*[F.lit(-o).alias(f"d{k}") for k, o in enumerate(offset)], F.lit(w).alias("w")) for offset, w in kernel.items()])
    rows = rows.withColumn("tap", F.explode(taps))
    rows = rows.select(*g.keys, *[(F.col(a) + F.col(f"tap.d{k}")).cast("int").alias(a) for k, a in enumerate(g.axes)], "x", F.col("tap.w").alias("w"))
    for a, n in zip(g.axes, g.extent, strict=True):
        rows = rows.where(F.col(a).between(0, n - 1))
    return rows.groupBy(*g.keys, *g.axes).agg(*[c.alias(name) for name, c in out.items()])


def _kind(g: Grid) -> str:
    return dict(g.df.dtypes)[g.value]


def weighted(g: Grid, kernel: Kernel, border: str = "clamp") -> Grid:
    """Correlation with a kernel, in double precision."""
    if tiles.goes_by_tiles(g, kernel):
        return tiles.weighted(g, kernel, border)
    return replace(g, df=gathered(g, kernel, border, **{g.value: F.sum(F.col("x").cast("double") * F.col("w"))}))


def convolve(g: Grid, kernel: Kernel, border: str = "clamp", kind: str | None = None) -> Grid:
    """Correlation with a kernel, truncated to the type of the grid (or ``kind``) if that is integral."""
    kind = kind or _kind(g)
    out = weighted(g, kernel, border)
    return out.mapped(lambda v: truncated(v, kind)) if kind in INTEGRAL else out


def on_axis(dims: int, axis: int, weights: list[float], first: int) -> Kernel:
    return {tuple(first + j if k == axis else 0 for k in range(dims)): w for j, w in enumerate(weights) if w}


def gaussian_blur(g: Grid, sigma: float, border: str = "clamp") -> Grid:
    """Gaussian blur, one axis after the other; integers are rounded at the end (truncated in one dimension)."""
    kind, w = _kind(g), gaussian_weights(sigma)
    out = g
    for k in range(g.dims):
        out = weighted(out, on_axis(g.dims, k, w, -(len(w) // 2)), border)
    if kind not in INTEGRAL:
        return out
    return out.mapped(lambda v: truncated(v, kind) if g.dims == 1 else F.round(v).cast(kind))


def downsample(g: Grid, factor: int, channel_axis: int | None = None) -> Grid:
    """Means of disjoint blocks; the last ones may be short. Integers are rounded."""
    if factor < 2:
        raise ValueError("the factor is 2 or more")
    kind = _kind(g)
    axes = [F.col(a) if k == channel_axis else F.expr(f"cast({a} div {factor} as int)").alias(a) for k, a in enumerate(g.axes)]
    mean = F.avg(g.value)
    value = F.round(mean).cast(kind) if kind in INTEGRAL else mean
    got = g.df.select(*g.keys, *axes, g.value).groupBy(*g.keys, *g.axes).agg(value.alias(g.value))
    return replace(g, df=got, extent=tuple(n if k == channel_axis else (n - 1) // factor + 1 for k, n in enumerate(g.extent)))


def gradient(g: Grid, border: str = "reflect") -> DataFrame:
    """Central differences: columns g0, g1, ... beside keys and axes, from one gathering."""
    kernel = {o: w for k in range(g.dims) for o, w in on_axis(g.dims, k, [-0.5, 0.0, 0.5], -1).items()}
    order = list(kernel.items())
    # the weight column carries the number of the tap
    shifted = {o: n + 1.0 for n, (o, _) in enumerate(order)}
    parts = {}
    for k in range(g.dims):
        parts[f"g{k}"] = F.sum(sum((F.when(F.col("w") == shifted[o], F.col("x") * w).otherwise(0.0) for o, w in order if o[k]), F.lit(0.0)))
    return gathered(g, shifted, border, **parts)


def box_blur(g: Grid, radius: int, border: str = "clamp") -> Grid:
    """Means over (2 radius + 1) per axis, one axis after the other; integers truncate."""
    kind = _kind(g)
    if kind == "boolean":
        raise TypeError("no means of booleans")
    out = g
    for k in range(g.dims):
        out = weighted(out, on_axis(g.dims, k, [1.0] * (2 * radius + 1), -radius), border)
    n = float((2 * radius + 1) ** g.dims)
    return out.mapped(lambda v: truncated(v / n, kind) if kind in INTEGRAL else v / n)


def erode(g: Grid, kernel: Kernel, border: str = "clamp") -> Grid:
    if tiles.goes_by_tiles(g, kernel):
        return tiles.extreme(g, kernel, border, False)
    return replace(g, df=gathered(g, kernel, border, **{g.value: F.min("x")}))


def dilate(g: Grid, kernel: Kernel, border: str = "clamp") -> Grid:
    if tiles.goes_by_tiles(g, kernel):
        return tiles.extreme(g, kernel, border, True)
    return replace(g, df=gathered(g, kernel, border, **{g.value: F.max("x")}))


def opened(g: Grid, kernel: Kernel, border: str = "clamp") -> Grid:
    return dilate(erode(g, kernel, border), kernel, border)


def closed(g: Grid, kernel: Kernel, border: str = "clamp") -> Grid:
    return erode(dilate(g, kernel, border), kernel, border)


def percentile_filter(g: Grid, kernel: Kernel, p: float, border: str = "clamp") -> Grid:
    """The value at rank round(p / 100 * (n - 1)) of the neighbourhood. A group holds as many values as the kernel has taps, at most ``tiles.MANY_TAPS``."""
    if tiles.goes_by_tiles(g, kernel):
        return tiles.ranked(g, kernel, p, border)
    n = len(kernel)
    rank = int(p / 100 * (n - 1) + 0.5)
    return replace(g, df=gathered(g, kernel, border, **{g.value: F.element_at(F.sort_array(F.collect_list("x")), rank + 1)}))


def median_filter(g: Grid, kernel: Kernel, border: str = "clamp") -> Grid:
    return percentile_filter(g, kernel, 50.0, border)
