"""The exact search for the two nearest vectors, and flow spread from moves, against brute force."""

import tracemalloc

import numpy as np
import pytest
from helpers import grid_of
from pyspark.sql import functions as F

from latticework.operators import flow, nearest


def frame_of(spark, x, name):
    return spark.createDataFrame([(k, None if v is None else [float(c) for c in v]) for k, v in enumerate(x)], f"{name} bigint, v array<double>")


def brute(x, y):
    out = {}
    for i, a in enumerate(x):
        d = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in enumerate(y))
        out[i] = d[:2]
    return out


def found(spark, x, y, block):
    rows = nearest.two_nearest(frame_of(spark, x, "i"), frame_of(spark, y, "j"), block).collect()
    return {r["i"]: [tuple(c) for c in r["c"]] for r in rows}


@pytest.mark.parametrize("block", [7, 50, 20_000])
def test_clusters_and_ties(spark, block):
    r = np.random.default_rng(block)
    centres = r.normal(size=(6, 5)) * 10
    y = centres[r.integers(0, 6, 180)] + r.normal(size=(180, 5))
    y[40:120:2] = y[40]  # forty equal vectors
    x = np.vstack([centres[r.integers(0, 6, 40)] + r.normal(size=(40, 5)), y[40:43], y[:3]])
    got, want = found(spark, x, y, block), brute(x, y)
    assert {i: [j for _, j in c] for i, c in got.items()} == {i: [j for _, j in c] for i, c in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-12 for i in want for a, b in zip(got[i], want[i], strict=True))


def test_lattice_points_have_many_ties(spark):
    r = np.random.default_rng(3)
    y, x = r.integers(0, 3, (150, 3)).astype(float), r.integers(0, 3, (40, 3)).astype(float)
    assert found(spark, x, y, 16) == brute(x, y)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_right_vectors(spark, n):
    x, y = np.eye(3), np.eye(3)[:n] * 2
    assert found(spark, [*x, None], [*y, None], 5) == ({} if not n else brute(x, y))


def test_most_blocks_are_not_visited(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 6)) * 20
    y, x = (centres[r.integers(0, 30, n)] + r.normal(size=(n, 6)) for n in (1500, 200))
    left, right = frame_of(spark, x, "i"), frame_of(spark, y, "j")
    blocks, first, shells = nearest.plan(left, right, 25)
    more = nearest.visited(first, nearest.meet(first, blocks, 25), shells).count()
    n = shells.count()
    assert n >= 60 and (more + len(x)) / len(x) < 0.1 * n, (more, n)
    assert found(spark, x, y, 25) == brute(x, y)


@pytest.mark.parametrize("equal", [False, True])
def test_memory_of_a_block(equal):
    """What is made beside the vectors follows neither the size of a block nor its ties."""
    r = np.random.default_rng(2)
    x, y = r.normal(size=(300, 16)), r.normal(size=(20_000, 16))
    name = r.permutation(len(y))
    if equal:
        y[5_000:] = y[5_000]
        x[::2] = y[5_000]
    tracemalloc.start()
    row, j, d = nearest.nearest_two(x, y, name)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20, peak
    assert row.tolist() == [k for k in range(len(x)) for _ in range(2)]
    for k in range(len(x)):
        far = np.sqrt(((x[k] - y) ** 2).sum(1))
        best = np.lexsort((name, far))[:2]
        assert j[2 * k : 2 * k + 2].tolist() == name[best].tolist() and (d[2 * k : 2 * k + 2] == far[best]).all()


def test_no_match_where_two_are_equally_near(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0])], "id bigint, descriptor array<double>")
    right = spark.createDataFrame([(5, [1.0, 0.0]), (4, [0.0, 1.0]), (6, [9.0, 9.0])], "id bigint, descriptor array<double>")
    assert flow.match(left, right).collect() == []
    assert [tuple(r) for r in flow.match(left, right, 1.5).collect()] == [(1, 4, 1.0)]


def plainly(shape, moves):
    want = np.zeros((*shape, 2))
    x, y = np.meshgrid(*map(np.arange, shape), indexing="ij")
    gap = (x[..., None] - [m[1] for m in moves]) ** 2.0 + (y[..., None] - [m[2] for m in moves]) ** 2.0
    d = np.array([m[3:] for m in moves])
    with np.errstate(divide="ignore", invalid="ignore"):
        w = 1 / gap
        want = (w[..., None] * d).sum(2) / w.sum(2)[..., None]
    for m in sorted(moves, reverse=True):
        want[m[1], m[2]] = m[3:]
    return want


@pytest.mark.parametrize("shape, n", [((256, 256), 500), ((9, 14), 3), ((5, 4), 1)])
def test_flow_from_moves(spark, shape, n):
    r = np.random.default_rng(n)
    moves = [(k, int(r.integers(shape[0])), int(r.integers(shape[1])), float(r.normal()), float(r.normal())) for k in range(n)]
    if n > 1:
        moves[1] = (1, moves[0][1], moves[0][2], 5.0, -5.0)  # two moves of one cell: the first one counts there, both elsewhere
    g = grid_of(spark, np.zeros((1, 1), int))
    g = type(g)(spark.range(shape[0] * shape[1]).select((F.col("id") % shape[0]).cast("int").alias("i0"), F.expr(f"cast(id div {shape[0]} as int)").alias("i1"), F.lit(0).alias("v")), ("i0", "i1"), shape)
    rows = flow.spread_matches(g, spark.createDataFrame(moves, "order bigint, x int, y int, d0 double, d1 double")).collect()
    want = plainly(shape, moves)
    assert len(rows) == shape[0] * shape[1]
    assert max(max(abs(c["u0"] - want[c["i0"], c["i1"]][0]), abs(c["u1"] - want[c["i0"], c["i1"]][1])) for c in rows) < 1e-9


def test_no_moves(spark):
    g = grid_of(spark, np.zeros((4, 3), int))
    rows = flow.spread_matches(g, spark.createDataFrame([], "order bigint, x int, y int, d0 double, d1 double")).collect()
    assert len(rows) == 12 and all(c["u0"] == 0 and c["u1"] == 0 for c in rows)
