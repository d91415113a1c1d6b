"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Iterative quantisation learns a rotation of the centred principal axes whose signs lose as little as
possible; several rotations from different starts give one long balanced code. Substrings of the code
are the keys of Hamming tables. Vectors under one key whose whole codes (``sketch``) are near enough are
compared with their original components.

How many tables of how many bits, how long the sketch and how far apart codes may be is measured: each
vector of a sample gets an invented partner right at the threshold, and the tables have to find the wanted share
of these pairs, and of the pairs of vectors with their farthest linked one in the sample. So vectors with a common direction, of which fewer bits agree after centring, get more tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, groups_of, pieces, smallest_reached, written

BLOCK = 1024  # vectors of one bucket that are compared at once
PAIR_COST = 0.01  # comparing two codes, in costs of one row of a table
LOST = 0.125  # of the pairs at the threshold that may be lost, the part that the distance of codes may lose
PASSING = 0.002  # other pairs that the distance of codes lets pass, about
CHECKED = 4000  # pairs of a vector of the sample and an invented partner
LEARNED = 8  # rotations that are learned; further ones are random, so that they fail on other pairs
MOST = 4096  # tables; where even these do not find the wanted share, one bucket holds all vectors and its blocks are compared


def learn_rotation(x: np.ndarray, seed: int, steps: int = 30) -> np.ndarray:
    """Rotation (dimensions x bits) for centred unit vectors ``x``; without steps a random one."""
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1]
    y = x @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((y.shape[1], y.shape[1])))
    for _ in range(steps):
        u, _, v = np.linalg.svd(y.T @ np.sign(y @ turn))
        turn = u @ v
    return axes @ turn


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component, so that no square overflows or vanishes."""
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def partners(unit: np.ndarray, least: float) -> np.ndarray:
    """For each unit vector another one at cosine ``least``, in a random direction."""
    w = np.random.default_rng(3).standard_normal(unit.shape)
    w -= (w * unit).sum(1, keepdims=True) * unit
    return least * unit + math.sqrt(1 - least * least) * w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)


def farthest_linked(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector that has others at cosine ``least`` or more, and the farthest of these."""
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -1)
    cosine[cosine < least] = np.inf
    far = cosine.argmin(1)
    has = np.isfinite(cosine[np.arange(len(unit)), far])
    return unit[has], unit[far[has]]


class Codes:
    """Rotations and the measured numbers: ``bits`` of a key, ``tables``, ``words`` of a sketch and ``apart``, the largest distance of sketches."""

    def __init__(self, unit: np.ndarray, n: int, least: float, recall: float):
        dims = unit.shape[1]
        self.mean = unit.mean(0)
        self.centred, self.turns = unit - self.mean, []
        few = np.resize(unit, (CHECKED, dims))  # a smaller sample gives each vector several partners, so that the share is measured as finely
        pair = partners(few, least)
        own, linked = farthest_linked(unit[:CHECKED], least)
        self._more()
        agree = float((self.signs(few) == self.signs(pair)).mean())
        # the cheapest number of bits: tables of a row each for every vector, and n / 2^bits codes to compare in each
        need = lambda b: math.log(1 - recall) / math.log(max(1e-300, 1 - min(agree, 1 - 1e-9) ** b))
        self.bits = min(range(1, min(30, dims) + 1), key=lambda b: max(1.0, need(b)) * (1 + PAIR_COST * n / 2**b))
        self.per, found, self.tables = dims // self.bits, np.zeros(len(few), bool), 0
        also = np.zeros(len(own), bool)
        while self.bits and (found.mean() < recall or (len(own) and also.mean() < recall)):
            while len(self.turns) * self.per <= self.tables:
                self._more()
            k = self.tables
            found |= self.keys(few, [k])[:, 0] == self.keys(pair, [k])[:, 0]
            also |= self.keys(own, [k])[:, 0] == self.keys(linked, [k])[:, 0]
            self.tables += 1
            if self.tables > MOST:
                self.bits, self.tables = 0, 1
        for self.words in (1, 2, 4, 8):
            while len(self.turns) * dims < 64 * self.words:
                self._more()
            mine, other = self.sketches(few), self.sketches(pair)
            apart, lost = np.bitwise_count(mine ^ other).sum(1), LOST * (1 - recall)
            self.apart = int(np.quantile(apart, 1 - lost, method="higher"))
            if lost * len(apart) < 1:  # a share too small to be counted among the pairs
                self.apart = max(self.apart, math.ceil(apart.mean() + NormalDist().inv_cdf(1 - lost) * apart.std()))
            if len(own):
                far = np.bitwise_count(self.sketches(own) ^ self.sketches(linked)).sum(1)
                self.apart = int(max(self.apart, np.quantile(far, recall, method="higher")))
            if (np.bitwise_count(mine ^ np.roll(mine, 1, axis=0)).sum(1) <= self.apart).mean() <= PASSING:
                break
        if not self.bits:  # all are compared
            self.apart = 64 * self.words

    def _more(self) -> None:
        self.turns.append(learn_rotation(self.centred, len(self.turns), 30 if len(self.turns) < LEARNED else 0))

    def signs(self, unit: np.ndarray, turns: list[int] | None = None) -> np.ndarray:
        x = unit - self.mean
        return np.hstack([x @ self.turns[k] > 0 for k in (range(len(self.turns)) if turns is None else turns)])

    def keys(self, unit: np.ndarray, tables: list[int] | None = None) -> np.ndarray:
        """Keys of the wanted tables; a key takes its bits from one rotation."""
        if not self.bits:
            return np.zeros((len(unit), 1), np.int64)
        tables, out = list(range(self.tables)) if tables is None else tables, []
        weight = 1 << np.arange(self.bits, dtype=np.int64)
        for turn in sorted({t // self.per for t in tables}):
            on = self.signs(unit, [turn])
            out += [on[:, (t % self.per) * self.bits :][:, : self.bits] @ weight for t in tables if t // self.per == turn]
        return np.stack(out, 1)

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        dims = unit.shape[1]
        on = self.signs(unit, list(range(-(-64 * self.words // dims))))[:, : 64 * self.words]
        return np.packbits(on, axis=1).view(np.uint64)


def vectors_of(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell on either side: two blocks of a bucket, or all of a block against itself."""
    side = cell.column("side").to_numpy()
    if cell.column("b1")[0].as_py() == cell.column("b2")[0].as_py():
        return (np.arange(len(side)),) * 2
    return np.flatnonzero(side == cell.column("b1")[0].as_py()), np.flatnonzero(side != cell.column("b1")[0].as_py())


CELL = ["spot", "b1", "b2"]


def near_codes(codes: Codes):
    """Rows of each cell that have another one whose code is near enough."""

    def run(batches: Iterator) -> Iterator:
        for cell in groups_of(batches, CELL):
            a, b = sides(cell)
            sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint64).reshape(cell.num_rows, -1)
            apart = sum(np.bitwise_count(sketch[a][:, None, k] ^ sketch[b][None, :, k]).astype(np.uint16) for k in range(codes.words))
            near = apart <= codes.apart
            if a is b:
                np.fill_diagonal(near, False)
            got = np.union1d(a[near.any(1)], b[near.any(0)])
            if len(got):
                out = cell.select([*CELL, "side", "head"]).take(pa.array(got)).combine_chunks()
                yield from out.to_batches()

    return run


def compared(codes: Codes, dims: int, least: float):
    """(head, links, to) of each cell: links counted, each in the first table in which a pair meets, and the smallest vector reached."""

    def run(batches: Iterator) -> Iterator:
        for cell in groups_of(batches, CELL):
            a, b = sides(cell)
            unit = unit_rows(vectors_of(cell.column("v"), dims))
            keys, table = vectors_of(cell.column("keys"), codes.tables), cell.column("spot")[0].as_py() >> 32
            sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint64).reshape(cell.num_rows, -1)
            i, j = np.nonzero(unit[a] @ unit[b].T >= least)
            i, j = a[i], b[j]
            good = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= codes.apart
            good &= ~(keys[i, :table] == keys[j, :table]).any(1)
            good &= (i < j) if a is b else True
            i, j = i[good], j[good]
            if len(i):
                head, copies = cell.column("head").to_numpy(), cell.column("copies").to_numpy()
                links = np.bincount(i, copies[j], len(head)) + np.bincount(j, copies[i], len(head))
                got = np.flatnonzero(links)
                arrays = [pa.array(head[got]), pa.array(links[got].astype(np.int64)), pa.array(smallest_reached(head, i, j)[got])]
                yield pa.RecordBatch.from_arrays(arrays, ["head", "links", "to"])

    return run


def links_of(same: DataFrame, dims: int, least: float, recall: float, sample: int) -> DataFrame | None:
    """Links (head, links, to) among distinct vectors (head, copies, v) of one length; None for less than two."""
    n = same.count()
    if n < 2:
        return None
    drawn = same.where(F.pmod(F.xxhash64("head"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))).select("v").toPandas()["v"]
    drawn = drawn if len(drawn) > 1 else same.limit(2).toPandas()["v"]
    codes = Codes(unit_rows(np.stack(list(drawn))), n, least, recall)
    codes.centred = None  # not needed any more, and tasks get a copy of the object

    def coded(batches: Iterator) -> Iterator:
        for part in pieces(batches, 4096):
            unit = unit_rows(vectors_of(part.column("v"), dims))
            keys = pa.ListArray.from_arrays(np.arange(len(unit) + 1, dtype=np.int32) * codes.tables, pa.array(codes.keys(unit).ravel()))
            sketch = pa.array([x.tobytes() for x in codes.sketches(unit)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, keys, sketch], [*part.schema.names, "keys", "sketch"])

    # codes are made once: made again beside other vectors, a sign within rounding of 0 could differ
    same = written(same.mapInArrow(coded, f"{', '.join(f'{c} {t}' for c, t in same.dtypes)}, keys array<bigint>, sketch binary"), "coded")
    spots = same.select(F.posexplode("keys").alias("t", "key"), "head", "sketch")
    spots = spots.select(F.col("key").bitwiseOR(F.shiftleft(F.col("t").cast("long"), 32)).alias("spot"), "head", "sketch")
    # only buckets of more than a block need to be dealt into blocks
    large = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    spots = spots.join(large, "spot", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1)))
    spots = spots.withColumn("side", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spots = spots.select("spot", F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"), "side", "head", "sketch")
    parts = 2 * int(same.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = lambda df: df.repartition(parts, *CELL).sortWithinPartitions(*CELL, "head")
    cell = "spot bigint, b1 int, b2 int, side int, head bigint"
    near = written(together(spots).mapInArrow(near_codes(codes), cell), "near")
    cells = near.join(same.select("head", "copies", "v", "keys", "sketch"), "head")
    found = written(together(cells).mapInArrow(compared(codes, dims, least), "head bigint, links bigint, to bigint"), "found")
    forget(near)
    forget(same)
    return found


def near_duplicates(df: DataFrame, least: float = 0.9, recall: float = 0.985, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Classes of vectors linked by a cosine of ``least`` or more: rows (vec_id, n_links, component_id, kept).

    One row per id. Vectors that are null, zero, or hold null or non-finite components link with
    nothing; a null id is left out. Of rows with one id the first by value counts. Vectors of different length do not
    link; each length is searched by itself. The codes are learned on about ``sample`` vectors drawn by a
    hash of the id, and ``recall`` is the share of pairs right at the threshold that the tables have to find; all
    vectors are indexed and compared. Other columns are not read.

    Equal vectors are put together first. Tables serve any number of vectors, from two on. A bucket of more than BLOCK vectors is dealt into blocks
    and every two blocks meet in one cell, so no task holds a large bucket. Tables hold ids and codes; original
    vectors move to a cell only when another code there is near. A cell counts links and keeps one link per vector towards
    the smallest one it reaches; pairs are never written. A pair counts in the first table in which it meets,
    so counts of all tables add up.
    """
    every = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null")
    every = every.groupBy("vec_id").agg(F.min("v").alias("v"))
    fine = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    kind = df.schema[vector_col].dataType
    every = written(every.select("vec_id", F.when(fine, F.transform("v", lambda c: c + F.lit(0.0).cast(kind.elementType))).alias("v")), "vectors")  # -0.0 becomes 0.0
    same = every.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    same = written(same.select("head", "copies", "v", F.size("v").alias("dims")), "distinct")
    lengths = [r["dims"] for r in same.select("dims").distinct().orderBy("dims").collect()]
    found = [x for x in (links_of(same.where(F.col("dims") == d).drop("dims"), d, least, recall, sample) for d in lengths) if x is not None]
    alone = same.sparkSession.createDataFrame([], "head bigint, links bigint, to bigint")
    found = reduce(DataFrame.union, found) if found else alone
    counts = found.groupBy("head").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("head").alias("a"), F.col("to").alias("b")))
    rows = same.join(counts, "head", "left").join(classes, F.col("head") == F.col("node"), "left")
    rows = rows.select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "head").alias("class"))
    out = every.join(rows, F.col("v") == F.col("w"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
