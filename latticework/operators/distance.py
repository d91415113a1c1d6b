"""Exact Euclidean distance transforms, axis by axis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..grid import Grid

FAR = 1e18  # fixed value: squared distance where there is no seed


def envelope(f: np.ndarray) -> np.ndarray:
    """min over q of f[q] + (x - q)^2 for every x, for the rows of ``f``.

    The best q never falls as x grows, so the cell halfway between two settled ones is searched between their
    best places only: n log n steps for lines of n cells. Blocks of lines bound the memory.
    """
    n = f.shape[1]
    out, size = np.empty_like(f), max(1, (1 << 20) // (n + 1))
    for at in range(0, len(f), size):
        part, step = f[at : at + size], 1 << n.bit_length() - 1
        best = np.zeros((len(part), n + 2), np.int64)  # cell x stands at x + 1, between two that are no cells
        best[:, n + 1] = n - 1
        while step:
            x = np.arange(step, n + 1, 2 * step)
            low, high = best[:, x - step].ravel(), best[:, np.minimum(x + step, n + 1)].ravel()
            many = high - low + 1
            start = np.cumsum(many) - many
            owner = np.repeat(np.arange(len(many)), many)
            q = np.arange(len(owner)) - (start - low)[owner]
            cost = part[owner // len(x), q] + (x[owner % len(x)] - 1 - q) ** 2
            least = np.minimum.reduceat(cost, start)
            first = np.flatnonzero(cost == least[owner])[::-1]
            place = np.empty(len(many), np.int64)
            place[owner[first]] = q[first]  # the first of equals is written last
            best[:, x] = place.reshape(len(part), -1)
            out[at : at + size, x - 1] = least.reshape(len(part), -1)
            step //= 2
    return np.minimum(out, FAR)


def squared(g: Grid, side: str = "background") -> Grid:
    """Squared distance to the nearest false cell (``side`` background) or true cell (foreground); 1e18 without any.

    One shuffle an axis: the lines along the axis are groups, whose size is the extent of the axis.
    """
    seed = (F.col(g.value).cast("double") == 0) if side == "background" else (F.col(g.value).cast("double") != 0)
    out = g.with_value(F.when(seed, 0.0).otherwise(FAR))
    for k, a in enumerate(g.axes):
        rest = [*g.keys, *[b for j, b in enumerate(g.axes) if j != k]]
        # lines as arrays, so that one Python call takes many of them
        lines = out.df.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(F.col(a).alias("x"), F.col(g.value).alias("f")))).alias("line"))
        lines = lines.select(*rest, F.transform("line", lambda c: c["f"]).alias("line"))

        def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    part["line"] = list(envelope(np.stack(part["line"].to_numpy())))
                yield part

        done = lines.mapInPandas(solve, lines.schema)
        out = replace(out, df=done.select(*rest, F.posexplode("line").alias(a, g.value)).select(*g.columns))
    return out


def distance(g: Grid, side: str = "background") -> Grid:
    return squared(g, side).mapped(F.sqrt)


def signed(g: Grid) -> Grid:
    """Distance to the other side, positive in the foreground and negative in the background."""
    inside, outside = distance(g), distance(g, "foreground")
    other = outside.df.withColumnRenamed(g.value, "__o")
    df = inside.df.join(other, [*g.keys, *g.axes])
    return replace(g, df=df.select(*g.keys, *g.axes, F.when(F.col(g.value) > 0, F.col(g.value)).otherwise(-F.col("__o")).alias(g.value)))
