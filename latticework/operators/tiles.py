"""Wide stencils and rank filters on dense tiles with halos.

Each cell is dealt once to the tile that it belongs to, and cells near the border of a tile, or of the grid
where the border rule repeats them, also to the tiles whose halo they stand in. A tile is then one group of bounded size, an array in
an Arrow task, and the kernel is moved over it there. So what is shuffled depends on the ratio of the reach to the side of a
tile, (1 + 2 reach / side) per axis, and not on the number of taps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import fold_index
from ..grid import Grid

Kernel = dict[tuple[int, ...], float]  # offset from the centre -> weight

TILE_CELLS = 65_536
#: Kernels with more taps than this go by tiles, smaller ones by rows in the JVM; both give the same cells.
MANY_TAPS = 49
KINDS = {"tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64, "boolean": np.bool_}


def padded(g: Grid, axis: int, low: int, high: int, border: str) -> DataFrame:
    """Rows with column ``p``: all places from -low to extent - 1 + high that stand for the cell."""
    n, a = g.extent[axis], g.axes[axis]
    if max(low, high) > n:
        raise ValueError(f"a reach of {max(low, high)} is more than the extent {n}")
    extra: dict[int, list[int]] = {}
    for p in [*range(-low, 0), *range(n, n + high)]:
        extra.setdefault(fold_index(p, n, border), []).append(p)
    if not extra:
        return g.df.withColumn("p", F.col(a))
    copies = F.create_map(*[x for i, ps in extra.items() for x in (F.lit(i), F.array(*map(F.lit, ps)))])
    return g.df.withColumn("p", F.explode(F.concat(F.array(F.col(a)), F.coalesce(F.try_element_at(copies, F.col(a)), F.array().cast("array<int>")))))


def goes_by_tiles(g: Grid, kernel: Kernel) -> bool:
    return len(kernel) > MANY_TAPS and dict(g.df.dtypes)[g.value] in KINDS


def reach(kernel: Kernel, axis: int) -> tuple[int, int]:
    offsets = [o[axis] for o in kernel]
    return max(0, -min(offsets)), max(0, max(offsets))


def sides(kernel: Kernel, dims: int, side: int | None = None) -> list[int]:
    """Cells of a tile along each axis, at least twice what the kernel reaches, so that the halo is at most as large again per axis."""
    side = side or max(8, round(TILE_CELLS ** (1 / dims)))
    return [max(side, 2 * max(reach(kernel, k))) for k in range(dims)]


def dealt(g: Grid, kernel: Kernel, border: str, side: int | None = None) -> DataFrame:
    """(keys, t0, ..., i0, ..., x): the cells of each tile and its halo, placed from the corner of the halo. Null cells are left out."""
    rows = g.df.withColumnRenamed(g.value, "x").where("x is not null")
    tiles = [f"__t{k}" for k in range(g.dims)]
    for k, (a, n, size) in enumerate(zip(g.axes, g.extent, sides(kernel, g.dims, side), strict=True)):
        low, high = reach(kernel, k)
        rows = padded(replace(g, df=rows, value="x"), k, low, high, border)
        first = F.greatest(F.lit(0), F.floor((F.col("p") - high) / size).cast("int"))
        last = F.least(F.lit((n - 1) // size), F.floor((F.col("p") + low) / size).cast("int"))
        rows = rows.withColumn(tiles[k], F.explode(F.sequence(first, last))).withColumn(a, F.col("p") - F.col(tiles[k]) * size + low).drop("p")
    return rows.select(*g.keys, *tiles, *g.axes, "x")


def over_tiles(g: Grid, kernel: Kernel, border: str, solve: Callable, kind: str, side: int | None = None) -> Grid:
    """Cells made tile by tile: ``solve(dense, have, taps, weights, out)`` gives the values and which of them exist.

    ``dense`` is the tile with its halo and ``have`` tells which of its cells are there; tap t of the output cell at p stands at p + taps[t].
    """
    if not kernel:
        raise ValueError("the kernel is empty")
    size, extent, axes, keys = sides(kernel, g.dims, side), g.extent, g.axes, g.keys
    low = np.array([reach(kernel, k)[0] for k in range(g.dims)])
    high = np.array([reach(kernel, k)[1] for k in range(g.dims)])
    taps, weights = np.array([*kernel]) + low, np.array([*kernel.values()])
    tiles, made = [f"__t{k}" for k in range(g.dims)], KINDS[kind]

    def run(part: pa.Table) -> pa.Table:
        at = np.array([part.column(t)[0].as_py() for t in tiles])
        out = np.minimum(size, np.array(extent) - at * size)
        shape = tuple(out + low + high)
        place = tuple(part.column(a).to_numpy() for a in axes)
        inside = np.all([p < n for p, n in zip(place, shape, strict=True)], axis=0)  # the last tile of an axis is cut
        place, x = tuple(p[inside] for p in place), part.column("x").to_numpy()[inside]
        dense, have = np.zeros(shape, x.dtype), np.zeros(shape, bool)
        dense[place], have[place] = x, True
        value, known = solve(dense, have, taps, weights, tuple(out))
        cells = np.nonzero(known)
        columns = [pa.array([part.column(k)[0].as_py()] * len(cells[0]), part.schema.field(k).type) for k in keys]
        columns += [pa.array((c + t * s).astype(np.int32)) for c, t, s in zip(cells, at, size, strict=True)]
        return pa.Table.from_arrays([*columns, pa.array(value[cells].astype(made))], [*keys, *axes, g_value])

    g_value = g.value
    types = dict(g.df.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"`{a}` int" for a in axes], f"`{g.value}` {kind}"])
    got = dealt(g, kernel, border, side).groupBy(*keys, *tiles).applyInArrow(run, schema)
    return replace(g, df=got)


def shifted(a: np.ndarray, taps: np.ndarray, out: tuple[int, ...]) -> Iterator[np.ndarray]:
    for tap in taps:
        yield a[tuple(slice(o, o + n) for o, n in zip(tap, out, strict=True))]


def weighted(g: Grid, kernel: Kernel, border: str = "clamp", side: int | None = None) -> Grid:
    """Correlation with a kernel, in double precision; missing cells add nothing, and a cell whose kernel covers none is missing."""

    def solve(dense, have, taps, weights, out):
        dense, total, known = dense.astype(float), np.zeros(out), np.zeros(out, bool)
        for part, w in zip(shifted(dense, taps, out), weights, strict=True):
            total += part * w
        for part in shifted(have, taps, out):
            known |= part
        return total, known

    return over_tiles(g, kernel, border, solve, "double", side)


def extreme(g: Grid, kernel: Kernel, border: str, largest: bool, side: int | None = None) -> Grid:
    """The smallest or largest cell that the kernel covers."""

    def solve(dense, have, taps, weights, out):
        pick = np.maximum if largest else np.minimum
        if dense.dtype.kind == "f":
            fill = -np.inf if largest else np.inf
        elif dense.dtype.kind == "b":
            fill = not largest
        else:
            fill = np.iinfo(dense.dtype).min if largest else np.iinfo(dense.dtype).max
        dense, best, known = np.where(have, dense, np.array(fill, dense.dtype)), None, np.zeros(out, bool)
        for part in shifted(dense, taps, out):
            best = part.copy() if best is None else pick(best, part, out=best)
        for part in shifted(have, taps, out):
            known |= part
        return best, known

    return over_tiles(g, kernel, border, solve, dict(g.df.dtypes)[g.value], side)


def ranked(g: Grid, kernel: Kernel, p: float, border: str = "clamp", side: int | None = None) -> Grid:
    """The value at rank round(p / 100 * (n - 1)) of the n cells that the kernel covers; missing cells do not count.

    A task holds a tile and, for one row of it after the other, the neighbourhoods of that row.
    """

    def solve(dense, have, taps, weights, out):
        box = tuple(taps.max(0) + 1)
        chosen = np.ravel_multi_index(tuple(taps.T), box)
        whole = bool(have.all())
        values = dense if whole else np.where(have, dense.astype(float), np.inf)
        result, known = np.zeros(out, values.dtype), np.ones(out, bool)
        for k in range(out[0]):
            strip = tuple([slice(k, k + box[0]), *[slice(0, n + b - 1) for n, b in zip(out[1:], box[1:], strict=True)]])
            around = np.lib.stride_tricks.sliding_window_view(values[strip], box)[0].reshape(*out[1:], -1)[..., chosen]
            if whole:
                rank = int(p / 100 * (len(chosen) - 1) + 0.5)
                result[k] = np.partition(around, rank, axis=-1)[..., rank]
                continue
            n = np.lib.stride_tricks.sliding_window_view(have[strip], box)[0].reshape(*out[1:], -1)[..., chosen].sum(-1)
            rank = (p / 100 * np.maximum(n - 1, 0) + 0.5).astype(int)
            result[k] = np.take_along_axis(np.sort(around, axis=-1), rank[..., None], -1)[..., 0]
            known[k] = n > 0
        return result, known

    return over_tiles(g, kernel, border, solve, dict(g.df.dtypes)[g.value], side)
