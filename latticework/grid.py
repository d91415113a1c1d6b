"""Grids: tables of cells with integer axes, and lazy views of them.

A ``Grid`` is a DataFrame with one row per cell, axis columns (axis 0 first), one value column
and, optionally, key columns that tell many grids in one table apart. Views only rewrite
coordinates, so they cost no shuffle and reach the scan as filters.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_CELLS = 100_000  # a grid of which every executor may get a copy


@dataclass(frozen=True)
class Grid:
    """``df`` has the ``axes`` (INT, from 0 to extent - 1), ``value`` and ``keys`` columns; spacing and unit are labels per axis."""

    df: DataFrame
    axes: tuple[str, ...]
    extent: tuple[int, ...]
    value: str = "v"
    keys: tuple[str, ...] = ()
    spacing: tuple[float, ...] | None = None
    unit: tuple[str, ...] | None = field(default=None)

    def __post_init__(self) -> None:
        if len(self.axes) != len(self.extent):
            raise ValueError("one extent for each axis is needed")
        if any(n < 1 for n in self.extent):
            raise ValueError("extents are 1 or more")
        missing = {*self.axes, self.value, *self.keys} - {*self.df.columns}
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    @property
    def dims(self) -> int:
        return len(self.axes)

    @property
    def size(self) -> int:
        n = 1
        for e in self.extent:
            n *= e
        return n

    @property
    def stride(self) -> tuple[int, ...]:
        """Cells between neighbours of each axis in the scan order, axis 0 fastest."""
        out, n = [], 1
        for e in self.extent:
            out.append(n)
            n *= e
        return tuple(out)

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.axes, self.value]

    def axis(self, k: int | str) -> int:
        """Number of an axis by number or name; negative numbers count from the end."""
        if isinstance(k, str):
            return self.axes.index(k)
        if not -self.dims <= k < self.dims:
            raise IndexError(f"axis {k} of {self.dims}")
        return k % self.dims

    def with_value(self, value: Column, name: str | None = None) -> Grid:
        """The same cells with another value; ``value`` may use the present one and the axes."""
        name = name or self.value
        return replace(self, df=self.df.select(*self.keys, *self.axes, value.alias(name)), value=name)

    def mapped(self, change) -> Grid:
        """The same cells with ``change`` applied to the value column."""
        return self.with_value(change(F.col(self.value)))

    def at(self, *coord: int) -> DataFrame:
        """The cell at ``coord``; one row per key."""
        self._inside(coord)
        return self.df.where(" and ".join(f"{a} = {int(c)}" for a, c in zip(self.axes, coord, strict=True)))

    def _inside(self, coord) -> None:
        if len(coord) != self.dims or any(not 0 <= c < n for c, n in zip(coord, self.extent, strict=True)):
            raise IndexError(f"{coord} is outside {self.extent}")

    def view(self, start, end=None, step=None) -> Grid:
        """Inclusive ranges per axis; None is the full axis, negatives count from the end.

        A negative step walks from ``end`` down. Ranges outside the grid or turned round, and step 0, raise.
        """
        start = start if isinstance(start, (tuple, list)) else (start,) * self.dims
        end = end if isinstance(end, (tuple, list)) else (end,) * self.dims
        step = step if isinstance(step, (tuple, list)) else (step,) * self.dims
        where, moved, extent = [], [], []
        for a, n, s, e, d in zip(self.axes, self.extent, start, end, step, strict=True):
            d = 1 if d is None else int(d)
            s = 0 if s is None else int(s)
            e = n - 1 if e is None else int(e)
            s, e = s + n if s < 0 else s, e + n if e < 0 else e
            if d == 0 or not 0 <= s < n or not 0 <= e < n or s > e:
                raise IndexError(f"range {s} to {e} by {d} on an axis of {n}")
            anchor = s if d > 0 else e
            c = F.col(a)
            where.append(c.between(s, e) & (F.pmod(c - anchor, F.lit(abs(d))) == 0) if abs(d) > 1 else c.between(s, e))
            moved.append(F.expr(f"cast((({a}) - {anchor}) div {d} as int)").alias(a))
            extent.append((e - s + abs(d)) // abs(d))
        df = self.df
        for w in where:
            df = df.where(w)
        return replace(self, df=df.select(*self.keys, *moved, self.value), extent=tuple(extent))

    def slice(self, axis: int | str, index: int) -> Grid:
        """The cells at one index of an axis, which is dropped."""
        k = self.axis(axis)
        n = self.extent[k]
        index = index + n if index < 0 else index
        if not 0 <= index < n:
            raise IndexError(f"index {index} on an axis of {n}")
        cut = lambda t: None if t is None else t[:k] + t[k + 1 :]
        return replace(self, df=self.df.where(F.col(self.axes[k]) == index).drop(self.axes[k]), axes=cut(self.axes), extent=cut(self.extent), spacing=cut(self.spacing), unit=cut(self.unit))

    def swap_axes(self, a: int | str, b: int | str) -> Grid:
        """The same cells with two axes exchanged; names stay in place."""
        a, b = self.axis(a), self.axis(b)
        order = list(range(self.dims))
        order[a], order[b] = order[b], order[a]
        turn = lambda t: None if t is None else tuple(t[k] for k in order)
        cells = [F.col(self.axes[k]).alias(self.axes[at]) for at, k in enumerate(order)]
        return replace(self, df=self.df.select(*self.keys, *cells, self.value), extent=turn(self.extent), spacing=turn(self.spacing), unit=turn(self.unit))

    def mirror(self, axis: int | str) -> Grid:
        k = self.axis(axis)
        return replace(self, df=self.df.withColumn(self.axes[k], (F.lit(self.extent[k] - 1) - F.col(self.axes[k])).cast("int")))

    def plane(self, a: int, b: int, cursor) -> Grid:
        """The plane of axes a and b (the lower one first) through ``cursor``."""
        a, b = sorted((self.axis(a), self.axis(b)))
        if a == b:
            raise ValueError("a plane needs two axes")
        self._inside(cursor)
        out = self
        for k in reversed(range(self.dims)):
            if k not in (a, b):
                out = out.slice(k, cursor[k])
        return out

    def planes(self, cursor) -> DataFrame:
        """All planes through ``cursor``: rows (keys, a, b, x, y, value) for each pair of axes a < b."""
        rows = None
        for a, b in combinations(range(self.dims), 2):
            p = self.plane(a, b, cursor)
            part = p.df.select(*self.keys, F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(p.axes[0]).alias("x"), F.col(p.axes[1]).alias("y"), self.value)
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def shift(self) -> Grid:
        """Each axis rolled by half its extent: (i + n div 2) mod n."""
        df = self.df
        for a, n in zip(self.axes, self.extent, strict=True):
            df = df.withColumn(a, ((F.col(a) + n // 2) % n).cast("int"))
        return replace(self, df=df)

    def filled(self, fill=0) -> Grid:
        """The dense grid: missing cells get ``fill``. With keys, each key that has a cell gets a whole grid."""
        spark = self.df.sparkSession
        cells = lattice(spark, self.extent, self.axes)
        if self.keys:
            # the keys that occur, each with the short list of axis 0, then the other axes
            cells = self.df.select(*self.keys).distinct()
            for a, n in zip(self.axes, self.extent, strict=True):
                cells = cells.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        kind = self.df.schema[self.value].dataType
        joined = cells.join(self.df, [*self.keys, *self.axes], "left")
        return replace(self, df=joined.select(*self.keys, *self.axes, F.coalesce(F.col(self.value), F.lit(fill).cast(kind)).alias(self.value)))

    def blocks(self) -> DataFrame:
        """One row per key: values as an array in scan order. For grids that fit a task."""
        place = sum((F.col(a) * F.lit(s) for a, s in zip(self.axes, self.stride, strict=True)), F.lit(0))
        got = self.df.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col(self.value).alias("x")))).alias("cells"))
        return got.select(*self.keys, F.transform("cells", lambda c: c["x"]).alias("payload"))


def at_cells(rows: DataFrame, g: Grid, cells: DataFrame, on) -> DataFrame:
    """``rows`` joined with ``cells``, the cells of ``g``. Rows are never broadcast: Spark takes exploded ones for as few as the table
    they come from. A small grid is broadcast instead; otherwise both sides are shuffled."""
    few = not g.keys and g.size <= FEW_CELLS
    return rows.join(F.broadcast(cells) if few else cells.hint("merge"), on)


def lattice(spark: SparkSession, extent, axes=None) -> DataFrame:
    """All coordinates of an extent, axis 0 fastest."""
    axes = axes or tuple(f"i{k}" for k in range(len(extent)))
    n = 1
    cols = []
    for a, e in zip(axes, extent, strict=True):
        cols.append(F.expr(f"cast((id div {n}) % {e} as int)").alias(a))
        n *= e
    return spark.range(n).select(*cols)


def raster(df: DataFrame, axes: dict[str, tuple[Column, int]], value: Column | None = None, keys=(), fill=0) -> Grid:
    """Bin the rows of a table: ``axes`` gives for each name an integer expression and its extent.

    ``value`` is an aggregate (the count if not given). Rows that fall outside are left out, cells without
    rows get ``fill``. One shuffle, after pre-aggregation.
    """
    cols = [c.cast("int").alias(a) for a, (c, _) in axes.items()]
    extra = [c for c in df.columns if c not in axes]
    rows = df.select(*extra, *cols) if extra else df.select(*cols)
    for a, (_, n) in axes.items():
        rows = rows.where(F.col(a).between(0, n - 1))
    got = rows.groupBy(*keys, *axes).agg((value if value is not None else F.count(F.lit(1))).alias("v"))
    return Grid(got, tuple(axes), tuple(n for _, n in axes.values()), keys=tuple(keys)).filled(fill)


def from_blocks(df: DataFrame, extent, keys=(), payload: str = "payload") -> Grid:
    """Cells of arrays in scan order."""
    axes, n, cols = tuple(f"i{k}" for k in range(len(extent))), 1, []
    for a, e in zip(axes, extent, strict=True):
        cols.append(F.expr(f"cast((pos div {n}) % {e} as int)").alias(a))
        n *= e
    return Grid(df.select(*keys, F.posexplode(payload).alias("pos", "v")).select(*keys, *cols, "v"), axes, tuple(extent), keys=tuple(keys))
