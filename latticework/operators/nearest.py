"""The two nearest vectors of a table for each vector of another, exactly, without meeting all of them.

The right vectors are dealt to the nearest of some pivots, each such cell is cut into shells by the distance from its pivot, and a shell that
is still large into parts: these are the blocks. A left vector first meets the one block that promises most; the second
distance found there bounds what it still has to see, and by the triangle inequality most other blocks cannot hold anything nearer. Only
the pivots are broadcast, at most MOST_PIVOTS vectors; bounds are joined by cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tomography import kept

MOST_PIVOTS = 256
SPARE = 1e-9  # of a distance, for rounding
AT_ONCE = 1 << 20  # numbers in any of a task's arrays beside the vectors of two blocks
BLOCK_ID = ["cell", "shell", "part"]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x to rows of y, the same for equal rows wherever they stand."""
    return np.sqrt(((x - y) ** 2).sum(-1))


def nearest_two(x: np.ndarray, y: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, name, distance) of the two rows of y nearest to each row of x; of equal distances the smaller names.

    A matrix product finds all rows that may be among them, however many are equally near; their exact distances decide. It is made for a
    few rows of x at a time, so that memory does not follow the size of the block or the number of ties.
    """
    rows, names, dist = [], [], []
    yy = np.einsum("ij,ij->i", y, y)
    strip, pairs = max(1, AT_ONCE // len(y)), max(1, AT_ONCE // max(1, y.shape[1]))
    for k in range(0, len(x), strip):
        part = x[k : k + strip]
        xx = (part * part).sum(1)
        rough = -2 * part @ y.T
        rough += xx[:, None]
        rough += yy
        spare = 1e-13 * y.shape[1] * (xx + yy.max())
        second = np.partition(rough, min(1, len(y) - 1), axis=1)[:, min(1, len(y) - 1)]
        i, j = np.nonzero(rough <= (second + 2 * spare)[:, None])
        d = np.concatenate([gaps(part[i[p : p + pairs]], y[j[p : p + pairs]]) for p in range(0, len(i), pairs)])
        order = np.lexsort((name[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, np.arange(len(part)))
        place = np.arange(len(i)) - first[i]
        keep = place < 2
        rows.append(i[keep] + k)
        names.append(name[j[keep]])
        dist.append(d[keep])
    return np.concatenate(rows), np.concatenate(names), np.concatenate(dist)


def meet(visits: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """(i, d, j): the two nearest of each block that a left vector visits. ``visits`` has (i, v) and the block's id, ``blocks`` (j, v) and it.

    The visitors of a block are dealt into groups of about ``block``, each of which gets a copy of the block.
    """
    groups = visits.groupBy(*BLOCK_ID).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
    left = visits.join(groups, BLOCK_ID).withColumn("group", F.pmod(F.xxhash64("i"), F.col("groups")).cast("int"))
    right = blocks.join(groups, BLOCK_ID).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["i", "d", "j"]
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], names)
        row, j, d = nearest_two(matrix(a.column("v")), matrix(b.column("v")), b.column("j").to_numpy())
        return pa.Table.from_arrays([pa.array(a.column("i").to_numpy()[row]), pa.array(d), pa.array(j)], names)

    by = [*BLOCK_ID, "group"]
    both = left.select(*by, "i", "v").groupBy(*by).cogroup(right.select(*by, "j", "v").groupBy(*by))
    return both.applyInArrow(run, "i bigint, d double, j bigint")


def placed(df: DataFrame, pivots: np.ndarray, every: bool) -> DataFrame:
    """The rows (n, v) with the number of the nearest pivot (``cell``) and its distance (``r``), or with ``every`` the distances of all pivots (``far``)."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            far = np.stack([gaps(x, p) for p in shared.value], 1)
            cell = far.argmin(1).astype(np.int32)
            last = pa.array(list(far), pa.list_(pa.float64())) if every else pa.array(far[np.arange(len(x)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), last], [*batch.schema.names, "cell", "last"])

    name = df.columns[0]
    kind = "array<double>" if every else "double"
    return df.mapInArrow(run, f"{name} bigint, v array<double>, cell int, last {kind}").withColumnRenamed("last", "far" if every else "r")


def blocks_of(right: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """(j, v, r) with cell, shell and part; equal vectors share a shell and are told apart by their names."""
    rows = placed(right, pivots, False)
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", [k / 64 for k in range(1, 64)], 1000).alias("cuts"))
    sizes = sizes.withColumn("shells", F.least(F.lit(64), F.ceil(F.col("n") / block)).cast("int"))
    edges = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("shells") - 1)), lambda k: F.col("cuts")[F.floor(k * 64 / F.col("shells")).cast("int") - 1]))
    sizes = sizes.select("cell", F.when(F.col("shells") > 1, edges).otherwise(F.array().cast("array<double>")).alias("edges"))
    rows = rows.join(sizes, "cell").withColumn("shell", F.size(F.filter("edges", lambda e: e < F.col("r")))).drop("edges")
    parts = rows.groupBy("cell", "shell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    return rows.join(parts, ["cell", "shell"]).withColumn("part", F.pmod(F.xxhash64("j"), F.col("parts")).cast("int")).select("j", "v", "r", *BLOCK_ID)


def plan(left: DataFrame, right: DataFrame, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, first, shells): blocks of (j, v), the first visit of each left vector (i, v, far) with its block's id, and the bounds of each block's distances."""
    n = right.count()
    if n <= block:  # one block, which all left vectors visit
        one = [F.lit(0).alias(b) for b in BLOCK_ID]
        return right.select("j", "v", *one), left.select("i", "v", *one), None
    few = right.orderBy(F.xxhash64(F.lit(17), "j"), "j").limit(min(-(-n // block), MOST_PIVOTS)).select("v").collect()
    pivots = np.array([r.v for r in few])
    blocks = blocks_of(right, pivots, block)
    shells = blocks.groupBy(*BLOCK_ID).agg(F.min("r").alias("least"), F.max("r").alias("most"))
    mine = placed(left, pivots, True)
    gap = F.greatest(F.lit(0.0), F.element_at("far", F.col("cell") + 1) - F.col("most"), F.col("least") - F.element_at("far", F.col("cell") + 1))
    first = mine.select("i", "v", "far", "cell").join(shells, "cell").groupBy("i").agg(F.min_by(F.struct("v", "far", *BLOCK_ID), F.struct(gap, "shell", "part")).alias("s"))
    first = first.select("i", "s.*")
    return blocks, first, shells


def visited(first: DataFrame, found: DataFrame, shells: DataFrame) -> DataFrame:
    """(i, v) with each block that may still hold one of the two nearest, by the second distance of the block seen first."""
    bound = found.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).select("i", F.when(F.col("n") > 1, F.col("d") * (1 + SPARE)).alias("bound"))
    rows = first.join(bound, "i", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    own = [F.col(b).alias(f"own_{b}") for b in BLOCK_ID]
    rows = rows.select("i", "v", "bound", F.array_min("far").alias("near"), *own, F.posexplode("far").alias("cell", "x"))
    # a vector of another cell is nearer to its own pivot than to the left vector's, and its distance from its pivot is known to lie between two bounds
    rows = rows.where((F.col("x") - F.col("near")) / 2 <= F.col("bound") + SPARE * F.col("x")).join(shells, "cell")
    rows = rows.where(F.greatest(F.col("x") - F.col("most"), F.col("least") - F.col("x")) <= F.col("bound") + SPARE * (F.col("x") + F.col("most")))
    return rows.where(~((F.col("cell") == F.col("own_cell")) & (F.col("shell") == F.col("own_shell")) & (F.col("part") == F.col("own_part")))).select("i", "v", *BLOCK_ID)


def two_nearest(left: DataFrame, right: DataFrame, block: int = 20_000) -> DataFrame:
    """(i, c): for each left vector (i, v) the array of (d, j) of its two nearest right vectors (j, v), nearest first, ties to the smaller j.

    Null vectors on either side are left out; vectors have one length. Both sides, the blocks and what is found first are written to the
    checkpoint folder, since each is read several times.
    """
    left, right = kept(left.where("v is not null")), kept(right.where("v is not null"))
    blocks, first, shells = plan(left, right, block)
    if shells is None:
        found = meet(first, blocks, block)
    else:
        blocks, first = kept(blocks), kept(first)
        found = kept(meet(first, blocks, block))
        found = found.unionByName(meet(visited(first, found, shells), blocks, block))
    return found.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("c")).select("i", F.slice("c", 1, 2).alias("c"))
