"""Fourier transforms of any size, one axis at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid


LINE = 1 << 16  # cells of a line that one task transforms


def along(df: DataFrame, axis: str, rest, inverse: bool) -> DataFrame:
    """Cells (rest, axis, re, im) transformed along ``axis``. Lines are gathered as arrays, and one Python call takes many of them."""
    lines = df.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(axis, "re", "im"))).alias("line"))
    lines = lines.select(*rest, F.transform("line", lambda c: c["re"]).alias("re"), F.transform("line", lambda c: c["im"]).alias("im"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy())
                y = np.fft.ifft(x, axis=1) if inverse else np.fft.fft(x, axis=1)
                part["re"], part["im"] = list(y.real), list(y.imag)
            yield part

    done = lines.mapInPandas(solve, lines.schema)
    return done.select(*rest, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "z")).select(*rest, axis, "z.re", "z.im")


def factors(n: int) -> tuple[int, int]:
    """The two factors of n that are nearest to each other, the smaller one first."""
    low = max(k for k in range(1, math.isqrt(n) + 1) if n % k == 0)
    return low, n // low


def fft(df: DataFrame, axes, keys=(), inverse: bool = False, extent=None, line: int = LINE) -> DataFrame:
    """Cells (keys, axes, re, im) transformed along ``axes``; the inverse is scaled by 1 / n.

    One shuffle an axis. Where ``extent`` tells that an axis has more than ``line`` cells and a divisor, its lines are not gathered: cell
    j = hi * n2 + lo is transformed over hi, turned by the angle of lo times the new index, and transformed over lo. Then no task holds more
    than a line of the larger factor, for two shuffles.
    """
    for k, a in enumerate(axes):
        rest = [*keys, *[b for b in axes if b != a]]
        n = extent[k] if extent else 0
        n1, n2 = factors(n) if n > line else (1, n)
        if n1 == 1:
            df = along(df, a, rest, inverse).select(*keys, *axes, "re", "im")
            continue
        cut = df.select(*rest, F.expr(f"cast(`{a}` div {n2} as int)").alias("__hi"), (F.col(a) % n2).cast("int").alias("__lo"), "re", "im")
        first = along(cut, "__hi", [*rest, "__lo"], inverse)
        angle = (F.col("__hi").cast("long") * F.col("__lo")) % n * ((2 if inverse else -2) * math.pi / n)
        turned = [(F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im")]
        last = along(first.select(*rest, "__hi", "__lo", *turned), "__lo", [*rest, "__hi"], inverse)
        df = last.withColumn(a, (F.col("__hi") + F.lit(n1) * F.col("__lo")).cast("int")).select(*keys, *axes, "re", "im")
    return df


def complex_cells(g: Grid) -> DataFrame:
    return g.df.select(*g.keys, *g.axes, F.col(g.value).cast("double").alias("re"), F.lit(0.0).alias("im"))


def fftn(g: Grid) -> DataFrame:
    """Transform of real cells: (keys, axes, re, im)."""
    return fft(complex_cells(g), g.axes, g.keys, extent=g.extent)


def ifftn(df: DataFrame, axes, extent, keys=()) -> Grid:
    """Real part of the inverse transform."""
    return Grid(fft(df, axes, keys, True, extent).withColumnRenamed("re", "v").drop("im"), tuple(axes), tuple(extent), keys=tuple(keys))


def from_channels(g: Grid, axis: int | str) -> DataFrame:
    """Complex cells of a grid whose axis of extent 2 holds real and imaginary parts."""
    k = g.axis(axis)
    if g.extent[k] != 2:
        raise ValueError("the channel axis has extent 2")
    rest = [a for a in g.axes if a != g.axes[k]]
    part = lambda c: F.sum(F.when(F.col(g.axes[k]) == c, F.col(g.value)).otherwise(0.0))
    return g.df.groupBy(*g.keys, *rest).agg(part(0).alias("re"), part(1).alias("im"))


def to_channels(df: DataFrame, axes, extent, axis: str = "c", keys=()) -> Grid:
    """The grid with a leading axis of real and imaginary parts."""
    rows = df.select(*keys, *axes, F.posexplode(F.array("re", "im")).alias(axis, "v"))
    return Grid(rows.select(*keys, axis, *axes, "v"), (axis, *axes), (2, *extent), keys=tuple(keys))


def correlate(g: Grid, kernel: dict[tuple[int, ...], float]) -> Grid:
    """Correlation with a kernel (offset -> weight) through the transform: equal to the stencil with border wrap."""
    spark = g.df.sparkSession
    placed: dict[tuple[int, ...], float] = {}
    for offset, w in kernel.items():
        at = tuple(o % n for o, n in zip(offset, g.extent, strict=True))
        placed[at] = placed.get(at, 0.0) + w
    rows = spark.createDataFrame([(*at, w) for at, w in placed.items()], [*g.axes, "v"])
    k = Grid(rows.select(*[F.col(a).cast("int").alias(a) for a in g.axes], "v"), g.axes, g.extent).filled(0.0)
    a, b = fftn(g), fftn(k).withColumnsRenamed({"re": "kr", "im": "ki"})
    both = a.join(b, list(g.axes)).select(*g.keys, *g.axes, (F.col("re") * F.col("kr") + F.col("im") * F.col("ki")).alias("re"), (F.col("im") * F.col("kr") - F.col("re") * F.col("ki")).alias("im"))
    return ifftn(both, g.axes, g.extent, g.keys)
