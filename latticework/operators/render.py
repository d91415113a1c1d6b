"""Pictures of grids: bars, heat maps, flow colours and arrows, slices, volume rendering, point queries."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import hsv_to_rgb, reduce_channels, truncated
from ..grid import Grid, at_cells, lattice
from . import reduce, stencil
from .histogram import percentiles
from .interp import tapped


def bar_chart(bars: Grid, width: int, height: int, on: int = 1, off: int = 0) -> Grid:
    """Bars of truncated height value / largest * height on columns [i W / n, (i + 1) W / n - 1]; of bars in one column the last one over 0 is drawn. Row 0 is the top."""
    n = bars.extent[0]
    top = bars.df.agg(F.greatest(F.lit(0.0), F.max(F.col(bars.value).cast("double"))).alias("top"))
    tall = bars.df.where(F.col(bars.value) > 0).join(F.broadcast(top)).select(F.col(bars.axes[0]).cast("long").alias("bar"), F.when(F.col("top") > 0, truncated(F.col(bars.value) / F.col("top") * height, "int")).otherwise(0).alias("tall"))
    spans = tall.withColumn("x", F.explode(F.sequence(F.expr(f"bar * {width} div {n}"), F.greatest(F.expr(f"bar * {width} div {n}"), F.expr(f"(bar + 1) * {width} div {n} - 1")))))
    spans = spans.groupBy(F.col("x").cast("int").alias("x")).agg(F.max_by("tall", "bar").alias("tall"))
    cells = lattice(bars.df.sparkSession, (width, height), ("x", "y")).join(spans, "x", "left")
    return Grid(cells.select("x", "y", F.when(F.lit(height) - F.col("y") <= F.coalesce("tall", F.lit(0)), on).otherwise(off).alias("v")), ("x", "y"), (width, height))


def heatmap(g: Grid, peak: int = 255) -> Grid:
    """value / largest * peak, truncated; all 0 if no value is over 0."""
    top = g.df.groupBy(*g.keys).agg(F.max(F.col(g.value).cast("double")).alias("top"))
    rows = g.df.join(top, list(g.keys)) if g.keys else g.df.join(F.broadcast(top))
    return Grid(rows.select(*g.keys, *g.axes, F.when(F.col("top") > 0, truncated(F.col(g.value) / F.col("top") * peak, "int")).otherwise(0).alias(g.value)), g.axes, g.extent, g.value, g.keys)


def windowed_heatmap(g: Grid, low: float = 5, high: float = 95, peak: int = 255) -> Grid:
    """The window between two percentiles spread over 0..peak; an empty window is a step at its value."""
    ends = percentiles(g, low, high)
    rows = g.df.join(ends, list(g.keys)) if g.keys else g.df.join(F.broadcast(ends))
    part = (F.greatest(F.col("p0"), F.least(F.col("p1"), F.col(g.value).cast("double"))) - F.col("p0")) / F.when(F.col("p1") > F.col("p0"), F.col("p1") - F.col("p0"))
    value = F.when(F.col("p1") > F.col("p0"), truncated(part * peak, "int")).otherwise(F.when(F.col(g.value) > F.col("p0"), peak).otherwise(0))
    return Grid(rows.select(*g.keys, *g.axes, value.alias(g.value)), g.axes, g.extent, g.value, g.keys)


def flow_magnitude(flow: DataFrame) -> DataFrame:
    return flow.select("*", F.sqrt(F.col("u0") * F.col("u0") + F.col("u1") * F.col("u1")).alias("magnitude"))


def flow_to_color(flow: DataFrame, axes, peak: int = 255, cap: float = -1.0) -> DataFrame:
    """Hue by direction and brightness by magnitude: columns r, g, b. The longest flow (or ``cap``) is brightest."""
    rows = flow_magnitude(flow)
    top = rows.agg(F.max("magnitude").alias("top")) if cap < 0 else None
    rows = rows.join(F.broadcast(top)) if cap < 0 else rows.withColumn("top", F.lit(float(cap)))
    hue = (F.atan2("u1", "u0") + math.pi) / (2 * math.pi)
    bright = F.when(F.col("top") > 0, F.least(F.lit(1.0), F.col("magnitude") / F.when(F.col("top") > 0, F.col("top")))).otherwise(0.0)
    return rows.select(*axes, *[truncated(c * peak, "int").alias(n) for c, n in zip(hsv_to_rgb(hue, F.lit(1.0), bright), "rgb", strict=True)])


def line_points(x0, y0, x1, y1):
    """Cells of a straight line as an array of structs, by equal steps of the longer side."""
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x1 - x0), F.abs(y1 - y0))).cast("int"))
    return F.transform(F.sequence(F.lit(0), steps), lambda k: F.struct(F.round(x0 + (x1 - x0) * k / steps).cast("int").alias("x"), F.round(y0 + (y1 - y0) * k / steps).cast("int").alias("y")))


def flow_to_arrows(flow: DataFrame, extent, spacing: int = 12, on: int = 255, cap: float = -1.0) -> Grid:
    """Arrows on a grid of ``spacing``; lengths are 0.45 spacing for the longest flow (or ``cap``, beyond which they do not grow), with a head of two strokes from length 1."""
    rows = flow_magnitude(flow).where(f"(i0 - {spacing // 2}) % {spacing} = 0 and (i1 - {spacing // 2}) % {spacing} = 0 and i0 >= {spacing // 2} and i1 >= {spacing // 2}")
    top = flow_magnitude(flow).agg(F.max("magnitude").alias("top"))
    rows = rows.join(F.broadcast(top)) if cap < 0 else rows.withColumn("top", F.lit(float(cap)))
    k = F.when(F.col("top") > 0, 0.45 * spacing / F.when(F.col("top") > 0, F.col("top"))).otherwise(0.0)
    k = F.when((F.col("top") > 0) & (F.col("magnitude") > F.col("top")), k * F.col("top") / F.col("magnitude")).otherwise(k)
    x0, y0 = F.col("i0").cast("double"), F.col("i1").cast("double")
    rows = rows.withColumns({"x1": x0 + F.col("u0") * k, "y1": y0 + F.col("u1") * k, "len": F.col("magnitude") * k})
    x1, y1, back = F.col("x1"), F.col("y1"), F.atan2("u1", "u0") + math.pi
    head = F.least(F.lit(4.0), 0.4 * F.col("len"))  # fixed values: length and angle of a head
    strokes = [line_points(x0, y0, x1, y1)]
    for side in (-0.49, 0.49):
        strokes.append(F.when(F.col("len") >= 1, line_points(x1, y1, x1 + head * F.cos(back + side), y1 + head * F.sin(back + side))).otherwise(F.array().cast("array<struct<x:int,y:int>>")))
    spots = rows.select(F.explode(F.concat(*strokes)).alias("p")).select(F.col("p.x").alias("i0"), F.col("p.y").alias("i1")).where(f"i0 between 0 and {extent[0] - 1} and i1 between 0 and {extent[1] - 1}").distinct()
    return Grid(spots.withColumn("v", F.lit(on)), ("i0", "i1"), tuple(extent)).filled(0)


def spread_window(value, low: float, high: float):
    """``low`` to ``high`` as 0 to 255, cut at both ends; an empty window is 0."""
    if high <= low:
        return F.lit(0)
    return F.round((F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value.cast("double"))) - low) / (high - low) * 255).cast("int")


def plane_of(g: Grid, axes, fixed: dict[int, int], color=None) -> Grid:
    """The plane of two axes in the wanted order, behind the colour axis if there is one; other axes stand at ``fixed``, cut to the grid, or at 0."""
    chosen = [*([] if color is None else [g.axis(color)]), *map(g.axis, axes)]
    if len({*chosen}) != len(chosen):
        raise ValueError("the axes of a plane are different ones")
    names = [g.axes[k] for k in chosen]
    for k in sorted({*range(g.dims)} - {*chosen}, reverse=True):
        g = g.slice(k, min(g.extent[k] - 1, max(0, int(fixed.get(k, 0)))))
    size = tuple(g.extent[g.axes.index(n)] for n in names)
    turn = lambda t: None if t is None else tuple(t[g.axes.index(n)] for n in names)
    return replace(g, axes=tuple(names), extent=size, spacing=turn(g.spacing), unit=turn(g.unit))


def render_slice(g: Grid, start, end, low: float, high: float, most=(256, 256), fixed: dict[int, int] | None = None, axes=None, color=None, reduction: str = "rgb") -> Grid:
    """A window of a plane, its values spread over 0..255, shrunk by the whole factor that brings the nearer of its sides down to ``most``; never enlarged.

    Without ``axes`` the plane has the two axes that are not in ``fixed``. With them it has these, in their order, and a ``color`` axis is reduced
    before the window (rgb keeps three values): the picture then has a leading channel axis. ``start`` and ``end`` are inclusive and, with ``axes``, cut to the plane; an empty one raises.
    """
    if axes is None:
        for axis in sorted(fixed or {}, reverse=True):
            g = g.slice(axis, fixed[axis])
        g = g.view(tuple(start), tuple(end))
        g = g.with_value(spread_window(F.col(g.value), low, high))
    else:
        g = plane_of(g, axes, fixed or {}, color)
        plane = g.extent[-2:]
        start, end = [max(0, s) for s in start], [min(n - 1, e) for n, e in zip(plane, end, strict=True)]
        if any(s > e for s, e in zip(start, end, strict=True)):
            raise ValueError("the window is empty")
        if color is None:
            g = g.view(tuple(start), tuple(end))
            g = g.with_value(spread_window(F.col(g.value), low, high))
        else:
            names, channel = g.axes[1:], g.axes[0]
            g = reduce.channels(g.view((0, *start), (g.extent[0] - 1, *end)), 0, reduction)
            n = 3 if reduction == "rgb" else 1
            values = F.col(g.value) if n == 3 else F.array(g.value)
            cells = g.df.select(*g.keys, *names, F.posexplode(values).alias(channel, g.value))
            cells = cells.select(*g.keys, channel, *names, spread_window(F.col(g.value), low, high).alias(g.value))
            g = Grid(cells, (channel, *names), (n, *g.extent), g.value, g.keys)
    factor = max(1, min(n // m for n, m in zip(g.extent[-2:], most, strict=True)))
    return stencil.downsample(g, factor, 0 if g.dims == 3 else None) if factor > 1 else g


def camera_rays(spark: SparkSession, extent, width: int, height: int, rotation=((1, 0, 0), (0, 1, 0), (0, 0, 1))) -> DataFrame:
    """Parallel rays of a turned camera through a volume of three axes that fills the cube from -1 to 1: (pixel0, pixel1, o0.., d0.., len).

    Origins and directions are in cells, and lengths in the cube, so that absorption does not depend on the extent.
    """
    x, y = (F.col("pixel0") + 0.5) / width * 2 - 1, (F.col("pixel1") + 0.5) / height * 2 - 1
    long = math.sqrt(sum(r[2] ** 2 for r in rotation)) or 1.0
    rows = lattice(spark, (width, height), ("pixel0", "pixel1"))
    cols = []
    for k, (r, n) in enumerate(zip(rotation, extent, strict=True)):
        far = r[2] / long
        cols += [(((x * r[0] + y * r[1] - far * math.sqrt(3)) * 0.5 + 0.5) * n - 0.5).alias(f"o{k}"), F.lit(far * 0.5 * n).alias(f"d{k}")]
    return rows.select("pixel0", "pixel1", *cols, F.lit(2 * math.sqrt(3)).alias("len"))


def render_volume(rays: DataFrame, volume: Grid, opacity: float, steps: int = 96, low: float = 0.0, high: float = 1.0, color=None, reduction: str = "rgb") -> DataFrame:
    """Volume rendering along rays (pixel, o0.., d0.., len): front to back, absorption 1 - exp(-v opacity 12 dt), stopped at 0.98.

    Values are the window from ``low`` to ``high`` spread over 0 to 1; an empty window is 0. Samples begin at the origin. A pixel is a
    group of ``steps`` samples. The channels of a ``color`` axis are sampled alike and reduced; of three (rgb) the brightness absorbs, and
    the column color is an array of three.
    """
    dt = F.col("len") / steps
    cols = [c for c in rays.columns if c.startswith("pixel")]
    space = [k for k in range(volume.dims) if color is None or k != volume.axis(color)]
    extent = [volume.extent[k] for k in space]
    rows = rays.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("dt", dt)
    rows = rows.select(*cols, "k", "dt", *[(F.col(f"o{j}") + F.col(f"d{j}") * F.col("k") * F.col("dt")).alias(f"c{j}") for j in range(len(space))])
    inside = " and ".join(f"c{j} between -0.5 and {n - 0.5}" for j, n in enumerate(extent))
    channel = F.lit(0) if color is None else F.col(volume.axes[volume.axis(color)])
    cells = volume.df.select(*[F.col(volume.axes[k]).alias(f"i{j}") for j, k in enumerate(space)], channel.alias("channel"), F.col(volume.value).cast("double").alias("x"))
    values = at_cells(tapped(rows.where(inside), extent, "linear", "clamp"), volume, cells, [f"i{j}" for j in range(len(space))])
    part = F.col("w") * F.col("x")
    count = 1 if color is None else volume.extent[volume.axis(color)]
    sums = values.groupBy(*cols, "k", "dt").agg(*[F.sum(F.when(F.col("channel") == c, part)).alias(f"s{c}") for c in range(count)])
    wide = color is not None and reduction == "rgb"
    seen = F.array(F.col("s0")) if color is None else reduce_channels([F.col(f"s{c}") for c in range(count)], reduction)
    seen = seen if color is None or wide else F.array(seen)
    shown = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low))) if high > low else F.lit(0.0)
    sums = sums.select(*cols, "k", "dt", F.transform(seen, shown).alias("c"))
    # fixed values: weights of brightness in the video standard
    bright = F.col("c")[0] * 0.299 + F.col("c")[1] * 0.587 + F.col("c")[2] * 0.114 if wide else F.col("c")[0]
    got = sums.withColumn("v", bright).groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct("k", "dt", "v", "c"))).alias("s"))
    none = F.struct(F.array(*[F.lit(0.0)] * (3 if wide else 1)).alias("c"), F.lit(0.0).alias("a"))

    def blend(acc, s):
        more = (1 - acc["a"]) * (1 - F.exp(-s["v"] * opacity * 12 * s["dt"]))
        return F.when(acc["a"] > 0.98, acc).otherwise(F.struct(F.zip_with(acc["c"], s["c"], lambda x, y: x + more * y).alias("c"), (acc["a"] + more).alias("a")))

    out = got.select(*cols, F.aggregate("s", none, blend).alias("z"))
    return out.select(*cols, (F.col("z.c") if wide else F.col("z.c")[0]).alias("color"), F.col("z.a").alias("alpha"))


def query_values(g: Grid, points: DataFrame, name: str = "point") -> DataFrame:
    """Values at coordinates c0, c1, ..., each cut to the grid."""
    at = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(f"c{k}"))).cast("int").alias(a) for k, (a, n) in enumerate(zip(g.axes, g.extent, strict=True))]
    return at_cells(points.select(name, *at), g, g.df, list(g.axes)).select(name, g.value)


class Renderers:
    """Named functions from a grid and parameters to a picture."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., Grid]] = {}

    def register(self, name: str, render: Callable[..., Grid]) -> None:
        self._known[name] = render

    def render(self, name: str, g: Grid, **params) -> Grid:
        if name not in self._known:
            raise KeyError(f"no renderer is named {name}")
        return self._known[name](g, **params)
