"""Projection of volumes along rays, its exact adjoint, and iterative reconstruction.

A view is a projection matrix of D rows and D + 1 columns, and a ray belongs to a view and a detector cell.
Rays are cut into samples, samples into interpolation taps, and taps are the entries of
the system matrix: projecting joins them with the cells and sums by ray, back-projecting joins
the same rows with the readings and sums by cell.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, at_cells, lattice
from . import stencil
from .histogram import k_means, nearest_level
from .interp import half_away, tapped
from .linalg import camera_centre, project_point, projection_slopes
from .prefix import box_corners, boxes_around, integral


def rays(spark: SparkSession, views: list[np.ndarray], detectors) -> DataFrame:
    """(view, u0, ..., o, d, m, e, far): origin and unit direction of each ray, its view's matrix, and the camera's centre or, if it is far, direction. Only the small matrices of the views are made on the driver."""
    rows = []
    for k, m in enumerate(views):
        m = np.asarray(m, float)
        d = m.shape[1] - 1
        centre, far = camera_centre(m)
        a, b = m[:, :d], m[:, d]
        if far:  # all rays are parallel: the origin moves with the detector cell
            pin = np.linalg.pinv(a)
            o = pin.copy()
            o[:, -1] -= pin @ b
            way = np.zeros((d, m.shape[0]))
            way[:, -1] = centre
        else:
            o = np.zeros((d, m.shape[0]))
            o[:, -1] = centre
            way = np.linalg.inv(a)
        rows.append((k, o.ravel().tolist(), way.ravel().tolist(), m.ravel().tolist(), centre.tolist(), far))
    d, n = np.asarray(views[0]).shape[1] - 1, np.asarray(views[0]).shape[0]
    table = spark.createDataFrame(rows, "view int, om array<double>, dm array<double>, m array<double>, e array<double>, far boolean")
    for k, e in enumerate(detectors):
        table = table.withColumn(f"u{k}", F.explode(F.sequence(F.lit(0), F.lit(e - 1))))
    u = [*[F.col(f"u{k}") for k in range(len(detectors))], F.lit(1.0)]
    times = lambda c: F.array(*[sum((F.col(c)[r * n + j] * u[j] for j in range(1, n)), F.col(c)[r * n] * u[0]) for r in range(d)])
    table = table.withColumn("o", times("om")).withColumn("d", times("dm"))
    norm = F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x))
    return table.select("view", *[f"u{k}" for k in range(len(detectors))], "o", F.transform("d", lambda x: x / norm).alias("d"), "m", "e", "far")


def units(table: DataFrame) -> list[str]:
    """The columns that name a ray."""
    return [c for c in table.columns if c not in ("o", "d", "m", "e", "far")]


def samples(table: DataFrame, extent, step: float = 1.0) -> DataFrame:
    """Trapezoid samples of rays inside the grid: their columns, c0, c1, ... and ds (weight of the sample)."""
    low, high = F.lit(-1e30), F.lit(1e30)
    for k, n in enumerate(extent):
        o, d = F.col("o")[k], F.col("d")[k]
        a, b = F.try_divide(-o, d), F.try_divide(F.lit(n - 1.0) - o, d)
        flat = F.abs(d) < 1e-12
        outside = (o < 0) | (o > n - 1)
        low = F.greatest(low, F.when(flat, F.when(outside, 1e30).otherwise(-1e30)).otherwise(F.least(a, b)))
        high = F.least(high, F.when(flat, F.when(outside, -1e30).otherwise(1e30)).otherwise(F.greatest(a, b)))
    rows = table.withColumn("t0", low).withColumn("t1", high).where("t1 > t0")
    rows = rows.withColumn("steps", F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / step).cast("int"))).withColumn("gap", (F.col("t1") - F.col("t0")) / F.col("steps"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    rows = rows.withColumn("t", F.col("t0") + F.col("k") * F.col("gap")).withColumn("ds", F.col("gap") * F.when((F.col("k") == 0) | (F.col("k") == F.col("steps")), 0.5).otherwise(1.0))
    keep = [c for c in table.columns if c not in ("o", "d")]  # the view's matrix goes with its samples
    return rows.select(*keep, "ds", *[(F.col("o")[k] + F.col("t") * F.col("d")[k]).alias(f"c{k}") for k in range(len(extent))])


def spread_of(rows: DataFrame, d: int) -> DataFrame:
    """Samples with h0, h1, ...: half the size of a detector cell where the sample is, along each of the ``d`` axes of the grid.

    The movement of the detector place with the sample, and the direction of the ray, are inverted; for 2 and 3 dimensions.
    """
    c = [F.col(f"c{k}") for k in range(d)]
    slope = projection_slopes(F.col("m"), c)
    way = [F.when(F.col("far"), F.col("e")[k]).otherwise(c[k] - F.col("e")[k]) for k in range(d)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    if d == 2:
        det = slope[0][0] * way[1] - slope[0][1] * way[0]
        sizes = [F.abs(way[1]), F.abs(way[0])]
    else:
        one, two = cross(slope[1], way), cross(way, slope[0])
        det = sum((slope[0][k] * one[k] for k in range(1, 3)), slope[0][0] * one[0])
        sizes = [F.abs(x) + F.abs(y) for x, y in zip(one, two, strict=True)]
    return rows.select("*", *[F.coalesce(F.try_divide(0.5 * x, F.abs(det)), F.lit(0.0)).alias(f"h{k}") for k, x in enumerate(sizes)])


def system(table: DataFrame, extent, step: float = 1.0, kind: str = "linear", antialias: bool = True) -> DataFrame:
    """Entries of the system matrix: (view, u0, ..., i0, ..., corner, a), one row per ray, cell and kind of entry.

    Where a detector cell spans more than one cell of the grid along any axis, the mean over the box of its size takes the place of the
    interpolation. Such a mean is written as the 2^D corners of the box in the summed-area table of the volume, so an entry with
    ``corner`` weighs a cell of that table and not of the volume: a sample has at most 2^D entries, however large its box is.
    """
    unit, axes = units(table), [f"i{k}" for k in range(len(extent))]
    rows = samples(table, extent, step)
    if not antialias:
        taps = tapped(rows, extent, kind, "clamp").select(*unit, *axes, F.lit(False).alias("corner"), "w", "ds")
    else:
        rows = spread_of(rows, len(extent))
        halves = [F.col(f"h{k}") for k in range(len(extent))]
        wide = F.greatest(*halves) > 0.5
        taps = tapped(rows.where(~wide), extent, kind, "clamp").select(*unit, *axes, F.lit(False).alias("corner"), "w", "ds")
        boxes = box_corners(boxes_around(rows.where(wide), extent, halves), axes)
        taps = taps.unionByName(boxes.select(*unit, *axes, F.lit(True).alias("corner"), (F.col("sign") / F.col("cells")).alias("w"), "ds"))
    return taps.groupBy(*unit, *axes, "corner").agg(F.sum(F.col("w") * F.col("ds")).alias("a"))


def forward(volume: Grid, entries: DataFrame, table: DataFrame) -> DataFrame:
    """Readings (view, u0, ..., v) of all rays; rays that miss the grid read 0."""
    unit, axes = units(table), [f"i{k}" for k in range(volume.dims)]
    cells = Grid(volume.df.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(volume.axes)], F.col(volume.value).cast("double").alias("x")), tuple(axes), volume.extent, "x")
    both = cells.df.withColumn("corner", F.lit(False)).unionByName(integral(cells).df.withColumn("corner", F.lit(True)))
    sums = at_cells(entries, cells, both, [*axes, "corner"]).groupBy(*unit).agg(F.sum(F.col("a") * F.col("x")).alias("v"))
    return table.select(*unit).join(sums, unit, "left").select(*unit, F.coalesce("v", F.lit(0.0)).alias("v"))


def back(readings: DataFrame, entries: DataFrame, extent) -> Grid:
    """The adjoint of ``forward``: what the corners get is summed from each cell to the ends, as a cell is part of all entries of the summed-area table behind it."""
    unit = [c for c in readings.columns if c != "v"]
    axes = tuple(f"i{k}" for k in range(len(extent)))
    sums = entries.join(readings.withColumnRenamed("v", "x"), unit).groupBy(*axes, "corner").agg(F.sum(F.col("a") * F.col("x")).alias("v"))
    direct, corners = (Grid(sums.where(F.col("corner") == on).drop("corner"), axes, tuple(extent)).filled(0.0) for on in (False, True))
    spread = integral(corners, backwards=True).df.withColumnRenamed("v", "s")
    return Grid(direct.df.join(spread, list(axes)).select(*axes, (F.col("v") + F.col("s")).alias("v")), axes, tuple(extent))


def density_bound(readings: DataFrame, views: list[np.ndarray], detectors, extent, step: float = 1.0) -> Grid:
    """Smallest max(0, reading) / step over the views in which a cell falls on a detector cell; infinite where none sees it."""
    spark = readings.sparkSession
    axes = tuple(f"i{k}" for k in range(len(extent)))
    table = spark.createDataFrame([(k, np.asarray(m, float).ravel().tolist()) for k, m in enumerate(views)], "view int, m array<double>")
    rows = lattice(spark, extent, axes).join(F.broadcast(table))  # as many rows as views, each with a small matrix
    for k, place in enumerate(project_point(F.col("m"), [F.col(a) for a in axes])):
        rows = rows.withColumn(f"u{k}", half_away(place))
    unit = ["view", *[f"u{k}" for k in range(len(detectors))]]
    seen = rows.drop("m").join(readings, unit, "left")
    least = F.min(F.when(F.col("v").isNotNull(), F.greatest(F.lit(0.0), F.col("v")) / step))
    return Grid(seen.groupBy(*axes).agg(F.coalesce(least, F.lit(float("inf"))).alias("v")), axes, tuple(extent))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that iterations do not pile up lineage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def landweber(readings: DataFrame, table: DataFrame, extent, rounds: int, rate: float, bound: Grid | None = None, start: Grid | None = None, step: float = 1.0, free: Grid | None = None, antialias: bool = True) -> Grid:
    """x <- x + rate * A'(y - A x), kept between 0 and ``bound``; only cells of ``free`` change if it is given."""
    axes = [f"i{k}" for k in range(len(extent))]
    unit = units(table)
    entries = kept(system(table, extent, step, antialias=antialias))
    x = start or Grid(lattice(table.sparkSession, extent).withColumn("v", F.lit(0.0)), tuple(axes), tuple(extent))
    for _ in range(rounds):
        now = forward(x, entries, table).withColumnRenamed("v", "p")
        rest = readings.join(now, unit).select(*unit, (F.col("v") - F.col("p")).alias("v"))
        change = back(rest, entries, extent).df.withColumnRenamed("v", "c")
        rows = x.df.join(change, axes)
        new = F.greatest(F.lit(0.0), F.col("v") + rate * F.col("c"))
        if bound is not None:
            rows = rows.join(bound.df.withColumnRenamed(bound.value, "top"), axes)
            new = F.least(new, F.col("top"))
        if free is not None:
            rows = rows.join(free.df.withColumnRenamed(free.value, "free"), axes, "left")
            new = F.when(F.coalesce(F.col("free").cast("boolean"), F.lit(False)), new).otherwise(F.col("v"))
        rows = rows.select(*axes, new.alias("v"))
        x = replace(x, df=kept(rows.select(*axes, "v")))
    return x


def discrete(x: Grid, readings: DataFrame, table: DataFrame, levels: int, rounds: int, inner: int, rate: float, step: float = 1.0, bound: Grid | None = None, antialias: bool = True) -> Grid:
    """Discrete refinement of a reconstruction.

    In each round cells whose neighbours all go to their nearest of ``levels`` levels are snapped to it and
    stay so from then on; the others are refined by ``inner`` steps under ``bound``. Those that never
    agree with their neighbours keep their values.
    """
    axes = list(x.axes)
    frozen = x.df.select(*axes, F.lit(False).alias("frozen"))
    for _ in range(rounds):
        found = k_means(x, levels)
        label = nearest_level(F.col(x.value), found)
        edge = stencil.gathered(x.with_value(label), stencil.cross_kernel(x.dims, 3), "clamp", low=F.min("x"), high=F.max("x"))
        state = x.df.join(edge.select(*axes, (F.col("low") == F.col("high")).alias("inside")), axes).join(frozen, axes)
        snapped = F.element_at(F.array(*map(F.lit, found)), label + 1)
        value = F.when(F.col("inside") & ~F.col("frozen"), snapped).otherwise(F.col(x.value))
        state = kept(state.select(*axes, value.alias(x.value), (F.col("inside") | F.col("frozen")).alias("frozen")))
        frozen = state.select(*axes, "frozen")
        free = Grid(state.select(*axes, (~F.col("frozen")).alias("v")), x.axes, x.extent)
        x = landweber(readings, table, x.extent, inner, rate, bound, replace(x, df=state.select(*axes, x.value)), step, free, antialias)
    return x


#: The head phantom of Shepp and Logan. Value in two dimensions, value in three, centre (x, y, z), half axes (x, y, z), turn about z in degrees.
HEAD = [
    (2.00, 1.00, 0.00, 0.0000, 0.00, 0.6900, 0.9200, 0.810, 0),
    (-0.98, -0.80, 0.00, -0.0184, 0.00, 0.6624, 0.8740, 0.780, 0),
    (-0.02, -0.20, 0.22, 0.0000, 0.00, 0.1100, 0.3100, 0.220, -18),
    (-0.02, -0.20, -0.22, 0.0000, 0.00, 0.1600, 0.4100, 0.280, 18),
    (0.01, 0.10, 0.00, 0.3500, -0.15, 0.2100, 0.2500, 0.410, 0),
    (0.01, 0.10, 0.00, 0.1000, 0.25, 0.0460, 0.0460, 0.050, 0),
    (0.01, 0.10, 0.00, -0.1000, 0.25, 0.0460, 0.0460, 0.050, 0),
    (0.01, 0.10, -0.08, -0.6050, 0.00, 0.0460, 0.0230, 0.050, 0),
    (0.01, 0.10, 0.00, -0.6060, 0.00, 0.0230, 0.0230, 0.020, 0),
    (0.01, 0.10, 0.06, -0.6050, 0.00, 0.0230, 0.0460, 0.020, 0),
]


def head_phantom(spark: SparkSession, extent) -> Grid:
    """The head phantom in two dimensions (its middle) or three; axis 1 runs downwards."""
    d = len(extent)
    if d not in (2, 3):
        raise ValueError("two or three dimensions")
    parts = []
    for flat, solid, x, y, z, *half, turn in HEAD:
        parts.append((flat if d == 2 else solid, *(x, -y, z)[:d], *half[:d], -turn))
    return phantom(spark, extent, parts)


def phantom(spark: SparkSession, extent, ellipses: list[tuple]) -> Grid:
    """Sums of ellipses (value, centre..., half axis...) in units of the extent from -1 to 1; one more number turns the first two axes, in degrees."""
    axes = tuple(f"i{k}" for k in range(len(extent)))
    cells = lattice(spark, extent, axes)
    d = len(extent)
    total = F.lit(0.0)
    for value, *rest in ellipses:
        away = [F.col(a) * 2.0 / max(1, n - 1) - 1 - rest[k] for k, (a, n) in enumerate(zip(axes, extent, strict=True))]
        if len(rest) > 2 * d and rest[2 * d]:
            c, s = np.cos(np.radians(rest[2 * d])), np.sin(np.radians(rest[2 * d]))
            away[:2] = [away[0] * float(c) + away[1] * float(s), away[1] * float(c) - away[0] * float(s)]
        far = sum(((x / rest[d + k]) * (x / rest[d + k]) for k, x in enumerate(away)), F.lit(0.0))
        total = total + F.when(far <= 1, float(value)).otherwise(0.0)
    return Grid(cells.select(*axes, total.alias("v")), axes, tuple(extent))


def torus(spark: SparkSession, extent, turn: np.ndarray, centre=(0.0, 0.0, 0.0), ring: float = 0.35, tube: float = 0.14, edge: float = 0.12) -> Grid:
    """A soft torus of 0 to 255 in the cube from -1 to 1: full inside, the square of a falling line over ``edge`` outside. ``turn`` is its 3 x 3 rotation."""
    axes = ("i0", "i1", "i2")
    at = [(F.col(a) + 0.5) * (2.0 / n) - 1.0 - float(c) for a, n, c in zip(axes, extent, centre, strict=True)]
    x, y, z = (sum((at[j] * float(turn[j][k]) for j in range(1, 3)), at[0] * float(turn[0][k])) for k in range(3))
    out = F.hypot(F.hypot(x, z) - ring, y) - tube
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - out / edge))
    return Grid(lattice(spark, extent, axes).select(*axes, F.floor(f * f * 255.0).cast("int").alias("v")), axes, tuple(extent))
