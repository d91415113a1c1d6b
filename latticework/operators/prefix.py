"""Summed-area tables, box queries over them, and their adjoints."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid, at_cells

BLOCK = 1 << 16  # cells of a line that one task sums


def running(df: DataFrame, axis: str, n: int, rest, value: str, backwards: bool = False, block: int = BLOCK) -> DataFrame:
    """``value`` summed from the start of each line along ``axis`` (of extent ``n``) up to each cell, or from its end.

    A line of more than ``block`` cells is summed block by block, as many tasks as it has blocks; the totals of its blocks, one row each,
    are then summed along the line, and what stands before a block is joined to its cells. ``rest`` are the columns that tell lines apart.
    """
    order = F.col(axis).desc() if backwards else F.col(axis)
    if n <= block:
        return df.withColumn(value, F.sum(value).over(Window.partitionBy(*rest).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = df.withColumn("__block", F.expr(f"`{axis}` div {block}"))
    order_of_blocks = F.col("__block").desc() if backwards else F.col("__block")
    before = Window.partitionBy(*rest).orderBy(order_of_blocks).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*rest, "__block").agg(F.sum(value).alias("__total"))
    totals = totals.select(*[F.col(c).alias(f"__{c}") for c in rest], F.col("__block").alias("__at"), F.sum("__total").over(before).alias("__before"))
    within = Window.partitionBy(*rest, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("__block") == F.col("__at")
    for c in rest:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = cut.withColumn(value, F.sum(value).over(within)).join(totals, on, "left")
    return joined.withColumn(value, F.col(value) + F.coalesce("__before", F.lit(0))).select(*df.columns)


def integral(g: Grid, backwards: bool = False, block: int = BLOCK) -> Grid:
    """Inclusive prefix sums along each axis in turn, or with ``backwards`` sums from each cell to the ends (the adjoint); one shuffle an axis, long lines in blocks."""
    df = g.df
    for k, (a, n) in enumerate(zip(g.axes, g.extent, strict=True)):
        rest = [*g.keys, *[b for j, b in enumerate(g.axes) if j != k]]
        df = running(df, a, n, rest, g.value, backwards, block)
    return replace(g, df=df.select(*g.columns))


def box_corners(boxes: DataFrame, axes) -> DataFrame:
    """A row for each corner that inclusive boxes (columns lo0, hi0, ...) have in a summed-area table: its place ``axes`` and its ``sign``; corners before the first cell count nothing."""
    corners = []
    for pick in product((0, 1), repeat=len(axes)):
        at = [(F.col(f"hi{k}") if p else F.col(f"lo{k}") - 1).cast("int").alias(a) for k, (p, a) in enumerate(zip(pick, axes, strict=True))]
        corners.append(F.struct(F.lit(1 if (len(axes) - sum(pick)) % 2 == 0 else -1).alias("sign"), *at))
    rows = boxes.withColumn("__c", F.explode(F.array(*corners))).select(*boxes.columns, "__c.*")
    for a in axes:
        rows = rows.where(F.col(a) >= 0)
    return rows


def rectangle_sums(table: Grid, boxes: DataFrame, box: str = "box") -> DataFrame:
    """Sums of the cells in inclusive boxes (columns ``box``, lo0, hi0, lo1, ...) from 2^dims corners of a summed-area table."""
    rows = box_corners(boxes.select(box, *[f"{side}{k}" for k in range(table.dims) for side in ("lo", "hi")]), table.axes)
    joined = at_cells(rows.select(box, *table.axes, "sign"), table, table.df, list(table.axes))
    sums = joined.groupBy(box).agg(F.sum(F.col("sign") * F.col(table.value)).alias("total"))
    return boxes.select(box).join(sums, box, "left").select(box, F.coalesce("total", F.lit(0).cast(dict(sums.dtypes)["total"])).alias("total"))


def boxes_around(points: DataFrame, extent, reach) -> DataFrame:
    """Boxes floor(c - h) .. ceil(c + h), cut to the grid, with their number of cells, for points with columns c0, c1, ..."""
    count = F.lit(1)
    for k, (n, h) in enumerate(zip(extent, reach, strict=True)):
        points = points.withColumn(f"lo{k}", F.greatest(F.lit(0), F.floor(F.col(f"c{k}") - h)).cast("int"))
        points = points.withColumn(f"hi{k}", F.least(F.lit(n - 1), F.ceil(F.col(f"c{k}") + h)).cast("int"))
        count = count * (F.col(f"hi{k}") - F.col(f"lo{k}") + 1)
    return points.withColumn("cells", count)


def box_means(table: Grid, points: DataFrame, reach, box: str = "box") -> DataFrame:
    """Means over boxes around points."""
    boxes = boxes_around(points, table.extent, reach)
    return rectangle_sums(table, boxes, box).join(boxes.select(box, "cells"), box).select(box, (F.col("total") / F.col("cells")).alias("mean"))


def scatter_boxes(boxes: DataFrame, extent, value: str = "v") -> Grid:
    """Add ``value`` to all cells of inclusive boxes: signed corners, then prefix sums. The dense grid comes out."""
    axes = tuple(f"i{k}" for k in range(len(extent)))
    corners = []
    for pick in product((0, 1), repeat=len(extent)):
        at = [(F.col(f"hi{k}") + 1 if p else F.col(f"lo{k}")).cast("int").alias(a) for k, (p, a) in enumerate(zip(pick, axes, strict=True))]
        corners.append(F.struct(F.lit(-1 if sum(pick) % 2 else 1).alias("sign"), *at))
    rows = boxes.select(value, F.explode(F.array(*corners)).alias("c")).select(value, "c.*")
    for a, n in zip(axes, extent, strict=True):
        rows = rows.where(F.col(a) < n)
    cells = rows.groupBy(*axes).agg(F.sum(F.col("sign") * F.col(value)).alias("v"))
    return integral(Grid(cells, axes, tuple(extent)).filled(0))


def scatter_means(points: DataFrame, extent, reach, value: str = "v") -> Grid:
    """The adjoint of ``box_means``: each value is spread evenly over its box."""
    boxes = boxes_around(points, extent, reach).withColumn(value, F.col(value).cast("double") / F.col("cells"))
    return scatter_boxes(boxes, extent, value)
