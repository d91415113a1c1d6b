"""Histograms, automatic thresholds, equalising, percentiles, one-dimensional clustering."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import bucket, truncated
from ..grid import Grid
from .arith import INTEGRAL


def ranged(g: Grid) -> DataFrame:
    """Cells with the smallest and largest value of their key in columns lo and hi.

    The ranges are one row per key; they are aggregated first and joined back.
    """
    ends = g.df.groupBy(*g.keys).agg(F.min(g.value).cast("double").alias("lo"), F.max(g.value).cast("double").alias("hi"))
    # without keys this is the one row of a global aggregate
    return g.df.join(ends, list(g.keys)) if g.keys else g.df.join(F.broadcast(ends))


def histogram(g: Grid, bins: int = 256, span: tuple[float, float] | None = None) -> DataFrame:
    """Rows (keys, bin, n, lo, hi) of the bins that occur; the range is closed at its upper end.

    It is that of each key's values or, if given, ``span``: what lies outside then counts in the first or last bin, and no range has to be found.
    """
    rows = ranged(g) if span is None else g.df.withColumns({"lo": F.lit(float(span[0])), "hi": F.lit(float(span[1]))})
    rows = rows.withColumn("bin", bucket(F.col(g.value), F.col("lo"), F.col("hi"), bins))
    return rows.groupBy(*g.keys, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def joint_histogram(df: DataFrame, columns: list[str], bins: list[int], spans: list[tuple[float, float]] | None = None) -> DataFrame:
    """Counts over bins of several columns, each over its own range or the given one."""
    if spans is None:
        ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
        rows = df.join(F.broadcast(ends))
    else:
        rows = df.withColumns({f"{n}_{c}": F.lit(float(x)) for c, span in zip(columns, spans, strict=True) for n, x in zip(("lo", "hi"), span, strict=True)})
    rows = rows.select(*[bucket(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), b).alias(f"b{k}") for k, (c, b) in enumerate(zip(columns, bins, strict=True))])
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def text_bars(h: DataFrame, bins: int, keys=(), width: int = 50) -> DataFrame:
    """(keys, bin, line) for every bin of a histogram: its edges, a bar of ``width`` signs for the largest count, and the count."""
    whole = h.groupBy(*keys).agg(F.max("n").alias("most"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = whole.join(h.select(*keys, "bin", "n"), [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    edge = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + k) / bins
    bar = F.repeat(F.lit("#"), F.floor(F.col("n") / F.col("most") * width).cast("int"))
    return rows.select(*keys, "bin", F.format_string("%10.1f - %10.1f | %s %d", edge(0), edge(1), bar, F.col("n")).alias("line"))


def text_table(h: DataFrame, bins: tuple[int, int]) -> DataFrame:
    """(b1, line) for every second bin of a joint histogram: its counts over the first bins, all with as many digits as the largest has."""
    digits = h.agg(F.length(F.max("n").cast("string")).alias("digits"))  # one row
    spark = h.sparkSession
    cells = spark.range(bins[0] * bins[1]).select((F.col("id") % bins[0]).cast("int").alias("b0"), F.expr(f"cast(id div {bins[0]} as int)").alias("b1"))
    rows = cells.join(h, ["b0", "b1"], "left").join(F.broadcast(digits)).withColumn("cell", F.lpad(F.coalesce("n", F.lit(0)).cast("string"), F.col("digits"), F.lit("0")))
    return rows.groupBy("b1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b0", "cell"))), lambda c: c["cell"]), " ").alias("line"))


def equalize(g: Grid, bins: int = 256) -> Grid:
    """Values moved to lo + (hi - lo) * cumulative share of their bin; integers truncate, a flat grid stays."""
    kind = dict(g.df.dtypes)[g.value]
    rows = ranged(g).withColumn("bin", bucket(F.col(g.value), F.col("lo"), F.col("hi"), bins))
    w = Window.partitionBy(*g.keys).orderBy("bin")  # at most ``bins`` rows
    counts = rows.groupBy(*g.keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    share = counts.select(*g.keys, "bin", F.sum("n").over(w).alias("c"), F.sum("n").over(Window.partitionBy(*g.keys)).alias("t"))
    rows = rows.join(share if g.keys else F.broadcast(share), [*g.keys, "bin"])
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("c") / F.col("t")
    value = F.when(F.col("hi") <= F.col("lo"), F.col(g.value).cast("double")).otherwise(value)
    return replace(g, df=rows.select(*g.keys, *g.axes, (truncated(value, kind) if kind in INTEGRAL else value).alias(g.value)))


def otsu(g: Grid, bins: int = 256) -> DataFrame:
    """The threshold that separates two classes best, one row per key; of equals the lowest bin wins."""
    h = histogram(g, bins).withColumns({"n": F.col("n").cast("double"), "bn": F.col("n").cast("double") * F.col("bin")})
    run, whole = Window.partitionBy(*g.keys).orderBy("bin"), Window.partitionBy(*g.keys)
    h = h.withColumns({"wb": F.sum("n").over(run), "sb": F.sum("bn").over(run), "t": F.sum("n").over(whole), "st": F.sum("bn").over(whole)})
    gap = F.col("sb") / F.col("wb") - F.try_divide(F.col("st") - F.col("sb"), F.col("t") - F.col("wb"))
    h = h.withColumn("between", F.when(F.col("t") > F.col("wb"), F.col("wb") * (F.col("t") - F.col("wb")) * gap * gap).otherwise(-1.0))
    best = h.groupBy(*g.keys).agg(F.max(F.struct("between", (-F.col("bin")).alias("o"))).alias("m"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    cut = F.when(F.col("hi") <= F.col("lo"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (1 - F.col("m.o")) / F.lit(float(bins)))
    kind = dict(g.df.dtypes)[g.value]
    return best.select(*g.keys, (truncated(cut, kind) if kind in INTEGRAL else cut).alias("threshold"))


def two_means(g: Grid, bins: int = 256, rounds: int = 100, tolerance: float = 1e-6) -> float:
    """Threshold halfway between the means below and above it, iterated over bin centres from the middle of the range; integers truncate. The histogram (``bins`` rows) is read by the driver."""
    rows = histogram(replace(g, keys=()), bins).collect()
    low, high = rows[0]["lo"], rows[0]["hi"]
    if high <= low:
        return low
    centre = {r["bin"]: low + (r["bin"] + 0.5) * (high - low) / bins for r in rows}
    t = (low + high) / 2
    whole = math.trunc if dict(g.df.dtypes)[g.value] in INTEGRAL else float
    for _ in range(rounds):
        mean = []
        for side in (True, False):
            mine = [r for r in rows if (centre[r["bin"]] <= t) == side]
            if not mine:
                return whole(t)
            mean.append(sum(centre[r["bin"]] * r["n"] for r in mine) / sum(r["n"] for r in mine))
        new = sum(mean) / 2
        if abs(new - t) < tolerance:
            return whole(new)
        t = new
    return whole(t)


def percentiles(g: Grid, *p: float) -> DataFrame:
    """Percentiles with linear interpolation, columns p0, p1, ..."""
    return g.df.groupBy(*g.keys).agg(*[F.percentile(F.col(g.value), F.lit(x / 100)).alias(f"p{k}") for k, x in enumerate(p)])


def k_means(g: Grid, k: int, rounds: int = 30) -> list[float]:
    """Levels of one-dimensional k-means from evenly spread starts; ties go to the lower level.

    Cells are first counted by value, and a round aggregates these counts, which are kept once they are made.
    """
    counts = g.df.groupBy(F.col(g.value).alias("x")).agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        return _levels(counts, k, rounds)
    finally:
        counts.unpersist()


def _levels(counts: DataFrame, k: int, rounds: int) -> list[float]:
    ends = counts.agg(F.min("x").cast("double"), F.max("x").cast("double")).first()
    levels = [ends[0] + (j + 0.5) * (ends[1] - ends[0]) / k for j in range(k)]
    for _ in range(rounds):
        got = {r["level"]: r["m"] for r in counts.groupBy(nearest_level(F.col("x"), levels).alias("level")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m")).collect()}
        new = [got.get(j, levels[j]) for j in range(k)]
        if new == levels:
            break
        levels = new
    return sorted(levels)


def nearest_level(v, levels: list[float]):
    """Number of the nearest of a few levels, the first of equals."""
    gap = [F.abs(v - F.lit(float(x))) for x in levels]
    least = F.least(*gap) if len(gap) > 1 else gap[0]
    pick = F.when(gap[0] == least, 0)
    for j in range(1, len(gap)):
        pick = pick.when(gap[j] == least, j)
    return pick
