"""Reductions over all cells or along an axis."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import truncated
from ..grid import Grid
from .arith import INTEGRAL

FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}


def total(g: Grid, *names: str) -> DataFrame:
    """One row per key with the named reductions of all cells."""
    return g.df.groupBy(*g.keys).agg(*[FUNCTIONS[n](g.value).alias(n) for n in names])


def along(g: Grid, name: str, axis: int | str) -> Grid:
    """Reduce along an axis, which stays with extent 1. The mean of integers truncates."""
    k = g.axis(axis)
    kind = dict(g.df.dtypes)[g.value]
    value: Column = FUNCTIONS[name](g.value)
    value = truncated(value, kind) if name == "mean" and kind in INTEGRAL else value
    rest = [a for a in g.axes if a != g.axes[k]]
    got = g.df.groupBy(*g.keys, *rest).agg(value.alias(g.value)).withColumn(g.axes[k], F.lit(0))
    return replace(g, df=got.select(*g.columns), extent=(*g.extent[:k], 1, *g.extent[k + 1 :]))


def largest(g: Grid) -> DataFrame:
    """The largest value, 0 if all are negative."""
    return g.df.agg(F.greatest(F.lit(0), F.max(g.value)).alias("largest"))


def channels(g: Grid, axis: int | str, mode: str) -> Grid:
    """Reduce a channel axis to one value: sum, mean, max, magnitude, or phase of two; rgb puts three channels into an array."""
    k = g.axis(axis)
    v = F.col(g.value)
    if mode == "phase":
        if g.extent[k] != 2:
            raise ValueError("phase takes 2 channels")
        pick = lambda c: F.max(F.when(F.col(g.axes[k]) == c, v))
        value = F.atan2(pick(1), pick(0))
    elif mode == "rgb":
        if g.extent[k] != 3:
            raise ValueError("rgb takes 3 channels")
        value = F.array(*[F.max(F.when(F.col(g.axes[k]) == c, v)) for c in range(3)])
    elif mode in ("sum", "mean", "max", "magnitude"):
        value = {"sum": F.sum(v), "mean": F.avg(v), "max": F.max(v), "magnitude": F.sqrt(F.sum(v.cast("double") * v))}[mode]
    else:
        raise ValueError(f"unknown mode {mode}")
    cut = lambda t: None if t is None else t[:k] + t[k + 1 :]
    rest = cut(g.axes)
    return Grid(g.df.groupBy(*g.keys, *rest).agg(value.alias(g.value)), rest, cut(g.extent), g.value, g.keys, cut(g.spacing), cut(g.unit))
