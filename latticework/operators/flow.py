"""Motion between frames: dense flow, keypoints, descriptors, matching."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, lattice
from . import fourier, nearest, stencil
from .linalg import solve, solve2
from .tomography import kept


def lucas_kanade(first: Grid, second: Grid, radius: int = 5, border: str = "reflect") -> DataFrame:
    """Flow of frames of any number of axes: (keys, axes, u0, u1, ...), 0 where the system of a cell is singular.

    The products of the slopes are box-averaged together, axis by axis, so the frames are shuffled
    once for the join and gradient and once for each axis. Systems of two axes are solved by columns, larger ones in batches.
    """
    if first.extent != second.extent:
        raise ValueError("two frames of one extent are needed")
    n = first.dims
    on = [*first.keys, *first.axes]
    slope = stencil.gradient(first, border)
    later = second.df.select(*[F.col(b).alias(a) for a, b in zip(on, [*second.keys, *second.axes], strict=True)], F.col(second.value).cast("double").alias("later"))
    rows = slope.join(first.df.select(*on, F.col(first.value).cast("double").alias("now")), on).join(later, on)
    dt = F.col("later") - F.col("now")
    g = [F.col(f"g{k}") for k in range(n)]
    names = {f"a{r}{c}": g[r] * g[c] for r in range(n) for c in range(r, n)} | {f"b{r}": g[r] * dt for r in range(n)}
    grid = Grid(rows.select(*on, F.struct(*[c.alias(k) for k, c in names.items()]).alias("v")), first.axes, first.extent, "v", first.keys)
    for k in range(n):
        kernel = stencil.on_axis(n, k, [1.0] * (2 * radius + 1), -radius)
        got = stencil.gathered(grid, kernel, border, **{c: F.sum(f"x.{c}") for c in names})
        grid = replace(grid, df=got.select(*on, F.struct(*names).alias("v")))
    count = float((2 * radius + 1) ** n)
    a = [[F.col(f"v.a{min(r, c)}{max(r, c)}") / count for c in range(n)] for r in range(n)]
    b = [-F.col(f"v.b{r}") / count for r in range(n)]
    if n == 2:
        u = solve2(a[0][0], a[0][1], a[1][0], a[1][1], b[0], b[1])
    else:
        solved = grid.df.select(*on, solve(F.array(*[x for r in a for x in r]), F.array(*b), n).alias("u"))
        grid, u = replace(grid, df=solved, value="u"), [F.col("u")[k] for k in range(n)]
    return grid.df.select(*on, *[F.coalesce(x, F.lit(0.0)).alias(f"u{k}") for k, x in enumerate(u)])


def keypoints(g: Grid, layers: int = 5, sigma: float = 1.6, contrast: float = 5.0) -> DataFrame:
    """Extrema of differences of Gaussians, blurred with reflected borders: (keys, axes, scale, strength of the response).

    A cell counts when its value is over (or under) all its neighbours in place and scale; a
    neighbour beyond the border repeats the cell itself, so border cells never count.
    """
    sigmas = [sigma * 2 ** (k / (layers - 3)) for k in range(layers)]
    wide = g.mapped(lambda v: v.cast("double"))
    on = [*g.keys, *g.axes]
    rows = None
    for k, s in enumerate(sigmas):
        blurred = stencil.gaussian_blur(wide, s, "reflect").df.withColumnRenamed(g.value, f"b{k}")
        rows = blurred if rows is None else rows.join(blurred, on)
    stack = F.array(*[F.col(f"b{k + 1}") - F.col(f"b{k}") for k in range(layers - 1)])
    # per middle layer the extremes of the three layers around it
    spread = []
    for k in range(1, layers - 2):
        three = [F.element_at(F.col("d"), j + 1) for j in (k - 1, k, k + 1)]
        spread.append(F.struct(F.lit(k).alias("layer"), three[1].alias("mid"), F.array(*three).alias("all")))
    cells = rows.select(*on, stack.alias("d")).select(*on, F.explode(F.array(*spread)).alias("v")).select(*on, "v.*")
    keys = (*g.keys, "layer")
    grid = Grid(cells.select(*g.keys, "layer", *g.axes, F.struct("mid", "all").alias("v")), g.axes, g.extent, "v", keys)
    kernel = stencil.box_kernel(g.dims, 3)
    centre = (0,) * g.dims
    numbered = {o: (2.0 if o == centre else 1.0) for o in kernel}
    own = F.col("w") == 2.0
    around = stencil.gathered(
        grid, numbered, "clamp", mid=F.max(F.when(own, F.col("x.mid"))),
        high=F.max(F.when(own, F.greatest(F.col("x.all")[0], F.col("x.all")[2])).otherwise(F.array_max("x.all"))),
        low=F.min(F.when(own, F.least(F.col("x.all")[0], F.col("x.all")[2])).otherwise(F.array_min("x.all"))),
    )
    found = around.where((F.abs("mid") >= contrast) & ((F.col("mid") > F.col("high")) | (F.col("mid") < F.col("low"))))
    for a, n in zip(g.axes, g.extent, strict=True):
        found = found.where(F.col(a).between(1, n - 2))
    scale = F.element_at(F.array(*map(F.lit, sigmas)), F.col("layer") + 1)
    return found.select(*on, scale.alias("scale"), F.abs("mid").alias("response"))


def descriptors(g: Grid, points: DataFrame, cells: int = 4, patch: float = 6.0) -> DataFrame:
    """Gradient histograms around keypoints (columns point, axes, scale): rows (point, descriptor).

    Keypoints meet the cells of their patch through blocks of the grid (a band join on block numbers), and each
    patch, a disc, is a group of bounded size. It is turned to the axes of its structure tensor, whose signs follow the mean
    gradient; each of cells^2 fields (the first turned axis fastest) sums the gradient by direction of the two axes.
    """
    if g.dims != 2:
        raise ValueError("descriptors take two dimensions")
    block = 16
    a, b = g.axes
    slope = stencil.gradient(g.mapped(lambda v: v.cast("double")))
    slope = slope.withColumns({"b0": F.floor(F.col(a) / block), "b1": F.floor(F.col(b) / block)}).select("b0", "b1", F.col(a).alias("x"), F.col(b).alias("y"), "g0", "g1")
    near = points.select("point", F.col(a).alias("px"), F.col(b).alias("py"), (F.col("scale") * patch).alias("r"))
    for c, p in (("b0", "px"), ("b1", "py")):
        near = near.withColumn(c, F.explode(F.sequence(F.floor((F.col(p) - F.col("r")) / block), F.floor((F.col(p) + F.col("r")) / block))))
    rows = near.join(slope, ["b0", "b1"]).where("(x - px) * (x - px) + (y - py) * (y - py) <= r * r")

    def describe(part: pd.DataFrame) -> pd.DataFrame:
        r = part["r"].iloc[0]
        d = np.stack([part["x"] - part["px"], part["y"] - part["py"]], 1).astype(float)
        gr = part[["g0", "g1"]].to_numpy(float)
        w = np.exp(-(d**2).sum(1) / (2 * (r / 2) ** 2))
        tensor = (gr * w[:, None]).T @ gr
        axes = np.linalg.eigh(tensor)[1][:, ::-1]
        mean = (gr * w[:, None]).sum(0)
        axes = axes * np.where(mean @ axes < 0, -1, 1)
        if np.linalg.det(axes) < 0:
            axes[:, -1] *= -1
        place, turned = d @ axes, gr @ axes
        field = np.clip(((place / r + 1) / 2 * cells).astype(int), 0, cells - 1)
        out = np.zeros((cells, cells, 4))
        for k in (0, 1):
            side = 2 * k + (turned[:, k] < 0)
            np.add.at(out, (field[:, 1], field[:, 0], side), np.abs(turned[:, k]) * w)
        flat = out.ravel()
        norm = np.linalg.norm(flat)
        return pd.DataFrame({"point": [part["point"].iloc[0]], "descriptor": [flat / norm if norm > 1e-12 else flat]})

    return rows.groupBy("point").applyInPandas(describe, "point bigint, descriptor array<double>")


def match(left: DataFrame, right: DataFrame, ratio: float = 0.8, name: str = "id", vector: str = "descriptor", block: int = 20_000) -> DataFrame:
    """Ratio-test matches (index0, index1, distance): the nearest right vector of each left one, if clearly nearer than the second.

    Ties go to the smaller index; a single candidate is kept. See ``nearest`` for the search.
    """
    side = lambda df, n: df.select(F.col(name).cast("long").alias(n), F.col(vector).cast("array<double>").alias("v"))
    two = nearest.two_nearest(side(left, "i"), side(right, "j"), block)
    first, second = F.col("c")[0], F.get("c", F.lit(1))
    keep = second.isNull() | (second["d"] == 0) | (first["d"] / F.when(second["d"] != 0, second["d"]) < ratio)
    return two.where(keep).select(F.col("i").alias("index0"), first["j"].alias("index1"), first["d"].alias("distance"))


def spread_matches(g: Grid, moves: DataFrame) -> DataFrame:
    """Dense flow from sparse moves (order, x, y, d0, d1), weighted by inverse squared distance: (axes, u0, u1).

    A cell on a move takes the first one. Without moves the flow is 0. The sums of weights and of weighted moves are convolutions of the moves,
    as cells of a grid, with the inverse squares of the lattice: products of transforms over a grid of twice the extent, so that no cell meets a move.
    Both components of the moves are one complex field. Moves start at cells of the grid.
    """
    a, b = g.axes
    n = tuple(2 * e for e in g.extent)
    spark = g.df.sparkSession
    around = [F.when(F.col(x) < e, F.col(x)).otherwise(F.col(x) - 2 * e) for x, e in zip(("i0", "i1"), g.extent, strict=True)]
    far = (around[0] * around[0] + around[1] * around[1]).cast("double")
    zero = F.lit(0.0)
    kernel = lattice(spark, n).select(F.lit("k").alias("field"), "i0", "i1", F.coalesce(F.try_divide(F.lit(1.0), far), zero).alias("re"), zero.alias("im"))
    at = moves.groupBy(F.col("x").cast("int").alias("i0"), F.col("y").cast("int").alias("i1"))
    at = at.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("d0").alias("s0"), F.sum("d1").alias("s1"), F.min(F.struct("order", "d0", "d1")).alias("hit"))
    cells = lattice(spark, n).join(at, ["i0", "i1"], "left")
    field = lambda name, re, im: cells.select(F.lit(name).alias("field"), "i0", "i1", F.coalesce(re, zero).alias("re"), F.coalesce(im, zero).alias("im"))
    fields = kernel.unionByName(field("w", F.col("n"), zero)).unionByName(field("m", F.col("s0"), F.col("s1")))
    spectra = fourier.fft(fields, ["i0", "i1"], ["field"], extent=n)
    # the lattice is symmetric, so its transform is real
    scale = spectra.where("field = 'k'").select("i0", "i1", F.col("re").alias("s"))
    product = spectra.where("field <> 'k'").join(scale, ["i0", "i1"]).select("field", "i0", "i1", (F.col("re") * F.col("s")).alias("re"), (F.col("im") * F.col("s")).alias("im"))
    back = fourier.fft(product, ["i0", "i1"], ["field"], inverse=True, extent=n)
    weight, moved = (back.where(F.col("field") == f).where((F.col("i0") < g.extent[0]) & (F.col("i1") < g.extent[1])) for f in "wm")
    sums = weight.select("i0", "i1", F.col("re").alias("w")).join(moved.select("i0", "i1", "re", "im"), ["i0", "i1"]).join(at.select("i0", "i1", "hit"), ["i0", "i1"], "left")
    # where there is no move at all, nothing but rounding stands in place of a weight
    pick = lambda k, c: F.coalesce(F.col(f"hit.d{k}"), F.when(F.col("w") > 1e-12, F.col(c) / F.col("w")), zero)
    return sums.select(F.col("i0").alias(a), F.col("i1").alias(b), pick(0, "re").alias("u0"), pick(1, "im").alias("u1"))


def sift_flow(first: Grid, second: Grid, contrast: float = 5.0, ratio: float = 0.8) -> DataFrame:
    """Keypoints of both frames, matched, and their moves spread over the grid."""
    sides = []
    for g in (first, second):
        found = keypoints(g, contrast=contrast)
        named = found.withColumn("point", (F.col(g.axes[0]) + F.col(g.axes[1]) * g.extent[0]).cast("long") * 100 + F.round(F.col("scale") * 10).cast("long") % 100)
        named = kept(named)  # read for the descriptors and again for the places of matches
        sides.append((named, descriptors(g, named)))
    matched = match(sides[0][1], sides[1][1], ratio, "point")
    a, b = first.axes
    p = sides[0][0].select(F.col("point").alias("index0"), F.col(a).alias("x"), F.col(b).alias("y"))
    q = sides[1][0].select(F.col("point").alias("index1"), F.col(second.axes[0]).alias("x1"), F.col(second.axes[1]).alias("y1"))
    moves = matched.join(p, "index0").join(q, "index1").select(F.col("index0").alias("order"), "x", "y", (F.col("x1") - F.col("x")).cast("double").alias("d0"), (F.col("y1") - F.col("y")).cast("double").alias("d1"))
    return spread_matches(first, moves)


def neighbours_above(g: Grid) -> DataFrame:
    """Cells with no larger neighbour: an anti join of cells and larger neighbours."""
    shifts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y])
    a, b = g.axes
    moved = g.df.withColumn("s", F.explode(shifts)).select((F.col(a) + F.col("s.x")).alias(a), (F.col(b) + F.col("s.y")).alias(b), F.col(g.value).alias("o"))
    best = moved.groupBy(a, b).agg(F.max("o").alias("o"))
    return g.df.join(best, (g.df[a] == best[a]) & (g.df[b] == best[b]) & (best["o"] > g.df[g.value]), "left_anti")
