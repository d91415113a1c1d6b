"""Elementwise arithmetic of grids, comparisons over all cells, differences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import truncated
from ..grid import Grid

OPS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "%": lambda a, b: a % b,
    "&": lambda a, b: a.bitwiseAND(b),
    "|": lambda a, b: a.bitwiseOR(b),
    "^": lambda a, b: a.bitwiseXOR(b),
}
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def combined(a: Grid, b: Grid, change) -> Grid:
    """Cells of two grids of one extent joined on keys and axes; ``change`` gets both values."""
    if a.extent != b.extent:
        raise ValueError(f"extents differ: {a.extent}, {b.extent}")
    on = [*a.keys, *a.axes]
    right = b.df.select(*[F.col(x).alias(y) for x, y in zip([*b.keys, *b.axes], on, strict=True)], F.col(b.value).alias("__b"))
    return replace(a, df=a.df.join(right, on).select(*on, change(F.col(a.value), F.col("__b")).alias(a.value)))


def _kind(g: Grid) -> str:
    return dict(g.df.dtypes)[g.value]


def _apply(kind: str, op: str):
    if op == "/":
        return (lambda x, y: F.when(y != 0, truncated(F.try_divide(x, y), kind))) if kind in INTEGRAL else (lambda x, y: F.try_divide(x, y))
    if op in "%&|^" and kind not in INTEGRAL:
        raise TypeError(f"{op} needs integers, not {kind}")
    return OPS[op]


def arith(a: Grid, op: str, b) -> Grid:
    """``a op b`` for a grid or scalar b. Integer division truncates; by zero it is null."""
    change = _apply(_kind(a), op)
    if isinstance(b, Grid):
        return combined(a, b, change)
    return a.mapped(lambda v: change(v, F.lit(b)))


def negate(a: Grid) -> Grid:
    return a.mapped(lambda v: -v)


def logical_not(a: Grid) -> Grid:
    return a.mapped(lambda v: (v == 0).cast("int"))


COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def holds(a: Grid, op: str, b) -> DataFrame:
    """One row: whether the comparison holds in every cell. ``!=`` is true if any cell differs; unequal extents are different."""
    if isinstance(b, Grid) and a.extent != b.extent:
        if op not in ("==", "!="):
            raise ValueError("extents differ")
        return a.df.sparkSession.range(1).select(F.lit(op == "!=").alias("holds"))
    pick = F.bool_or if op == "!=" else F.bool_and
    test = (lambda x, y: ~x.eqNullSafe(y)) if op == "!=" else (lambda x, y: x.eqNullSafe(y)) if op == "==" else COMPARE[op]
    cells = combined(a, b, test) if isinstance(b, Grid) else a.mapped(lambda v: test(v, F.lit(b)))
    return cells.df.agg(pick(F.col(cells.value)).alias("holds"))


def rmse(a: Grid, b: Grid) -> DataFrame:
    return combined(a, b, lambda x, y: (x - y).cast("double")).df.agg(F.sqrt(F.avg(F.col(a.value) * F.col(a.value))).alias("rmse"))


def mismatches(a: Grid, b: Grid) -> DataFrame:
    """Number of differing cells and the largest difference."""
    diff = combined(a, b, lambda x, y: F.abs(x - y)).df
    return diff.agg(F.count_if(F.col(a.value) > 0).alias("n"), F.max(a.value).alias("largest"))


def per_channel(g: Grid, axis: int | str, change) -> Grid:
    """``change`` applied to each index of an axis: the axis becomes a key, so all run at once."""
    k = g.axis(axis)
    cut = lambda t: None if t is None else t[:k] + t[k + 1 :]
    inner = Grid(g.df, cut(g.axes), cut(g.extent), g.value, (*g.keys, g.axes[k]), cut(g.spacing), cut(g.unit))
    out = change(inner)
    axes = (*out.axes[:k], g.axes[k], *out.axes[k:])
    extent = (*out.extent[:k], g.extent[k], *out.extent[k:])
    return Grid(out.df.select(*g.keys, *axes, out.value), axes, extent, out.value, g.keys)


def packed(g: Grid, words: int = 64) -> DataFrame:
    """Non-zero cells as bits: rows (keys, word, bits)."""
    place = sum((F.col(a).cast("long") * F.lit(s) for a, s in zip(g.axes, g.stride, strict=True)), F.lit(0))
    on = g.df.where(F.col(g.value).cast("double") != 0).select(*g.keys, (place / words).cast("long").alias("word"), (place % words).cast("int").alias("at"))
    return on.groupBy(*g.keys, "word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))


def unpacked(bits: DataFrame, extent, on=1, off=0, keys=(), words: int = 64) -> Grid:
    """Cells of packed bits; words that are not there are all off."""
    axes, n, cols = tuple(f"i{k}" for k in range(len(extent))), 1, []
    rows = bits.select(*keys, "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("at")).where("(shiftrightunsigned(bits, at) & 1) = 1")
    rows = rows.withColumn("place", F.col("word") * words + F.col("at"))
    for a, e in zip(axes, extent, strict=True):
        cols.append(F.expr(f"cast((place div {n}) % {e} as int)").alias(a))
        n *= e
    return Grid(rows.select(*keys, *cols, F.lit(on).alias("v")), axes, tuple(extent), keys=tuple(keys)).filled(off)


def bit_summary(bits: DataFrame, size: int) -> DataFrame:
    """count, any and all of packed bits."""
    n = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    return bits.agg(n.cast("long").alias("n"), (n > 0).alias("any"), (n == size).alias("all"))


def scalar(v) -> Column:
    return F.lit(v)


def salt_and_pepper(g: Grid, share: float, low, high, seed: int = 0, together: tuple[str, ...] = ()) -> Grid:
    """``share`` of the cells set to ``low`` or ``high``, drawn by a hash of keys and axes, so every run gives the same cells.

    Cells that differ only along the axes ``together`` (channels) share their fate. A null cell may be set too.
    """
    place = [c for c in (*g.keys, *g.axes) if c not in together]
    drawn = F.md5(F.concat_ws(",", F.lit(str(seed)), *[F.col(c).cast("string") for c in place]))
    part = lambda at: F.conv(F.substring(drawn, at, 8), 16, 10).cast("long")
    kind = g.df.schema[g.value].dataType
    new = F.when(part(1) < int(share * 2**32), F.when(part(9) % 2 == 0, F.lit(low)).otherwise(F.lit(high)).cast(kind)).otherwise(F.col(g.value))
    return g.with_value(new)
