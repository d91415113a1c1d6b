"""Wide stencils on tiles against brute force, whatever the side of a tile."""

from itertools import product

import numpy as np
import pytest
from helpers import array_of, grid_of

from latticework.functions.cells import fold_index
from latticework.grid import Grid
from latticework.operators import stencil, tiles


def around(a, kernel, border):
    """For each cell the values under the kernel, in the order of its taps."""
    out = np.empty((*a.shape, len(kernel)), a.dtype)
    for c in np.ndindex(*a.shape):
        for t, o in enumerate(kernel):
            out[c][t] = a[tuple(fold_index(x + d, n, border) for x, d, n in zip(c, o, a.shape, strict=True))]
    return out


LOPSIDED = {(x, y): 1.0 + x - 3.0 * y for x in range(-2, 6) for y in range(-4, 3) if (x + y) % 3}


@pytest.mark.parametrize("border", ["clamp", "wrap", "reflect"])
@pytest.mark.parametrize("side", [8, 12, 200])
def test_planes(spark, border, side):
    a = np.random.default_rng(side).integers(-50, 50, (23, 31))
    near, w = around(a, LOPSIDED, border), np.array([*LOPSIDED.values()])
    g = grid_of(spark, a)
    assert np.abs(array_of(tiles.weighted(g, LOPSIDED, border, side)) - (near * w).sum(-1)).max() < 1e-9
    assert (array_of(tiles.extreme(g, LOPSIDED, border, False, side)) == near.min(-1)).all()
    assert (array_of(tiles.extreme(g, LOPSIDED, border, True, side)) == near.max(-1)).all()
    for p in (0, 30, 50, 100):
        assert (array_of(tiles.ranked(g, LOPSIDED, p, border, side)) == np.sort(near, -1)[..., int(p / 100 * (len(LOPSIDED) - 1) + 0.5)]).all()


@pytest.mark.parametrize("shape, width", [((300,), 65), ((14, 9, 11), 5)])
def test_other_dimensions(spark, shape, width):
    a = np.random.default_rng(1).normal(size=shape)
    kernel = stencil.box_kernel(len(shape), width)
    near = around(a, kernel, "clamp")
    g = grid_of(spark, a, "double")
    assert len(kernel) > tiles.MANY_TAPS and tiles.goes_by_tiles(g, kernel)
    assert np.abs(array_of(stencil.convolve(g, kernel)) - near.sum(-1)).max() < 1e-9
    assert (array_of(stencil.erode(g, kernel)) == near.min(-1)).all() and (array_of(stencil.dilate(g, kernel)) == near.max(-1)).all()
    assert (array_of(tiles.ranked(g, kernel, 50, side=6)) == np.sort(near, -1)[..., int(0.5 * (len(kernel) - 1) + 0.5)]).all()


def test_small_and_wide_kernels_agree(spark, monkeypatch):
    g, kernel = grid_of(spark, np.random.default_rng(5).integers(0, 9, (12, 10))), stencil.box_kernel(2, 3)
    for f in (stencil.convolve, stencil.erode, stencil.dilate, stencil.median_filter, stencil.opened):
        by_rows = array_of(f(g, kernel))
        monkeypatch.setattr(tiles, "MANY_TAPS", 1)
        assert (array_of(f(g, kernel)) == by_rows).all()
        monkeypatch.undo()


def test_keys_booleans_and_missing_cells(spark):
    r = np.random.default_rng(9)
    made = {k: r.integers(0, 100, (9, 10)) for k in ("a", "b", None)}
    gone = {k: r.random((9, 10)) < 0.5 for k in made}
    rows = [(k, x, y, None if gone[k][x, y] and (x + y) % 2 else int(made[k][x, y])) for k in made for x, y in np.ndindex(9, 10) if not gone[k][x, y] or (x + y) % 2]
    g = Grid(spark.createDataFrame(rows, "name string, i0 int, i1 int, v bigint"), ("i0", "i1"), (9, 10), keys=("name",))
    kernel = {(x, y): 1.0 for x, y in product((-1, 0, 1), repeat=2) if x or y}
    got = [{(c.name, c.i0, c.i1): c.v for c in f.df.collect()} for f in (tiles.ranked(g, kernel, 50, "clamp", 8), tiles.extreme(g, kernel, "clamp", True, 8), tiles.weighted(g, kernel, "clamp", 8))]
    seen = 0
    for k, (x, y) in product(made, np.ndindex(9, 10)):
        at = [(fold_index(x + a, 9, "clamp"), fold_index(y + b, 10, "clamp")) for a, b in kernel]
        near = sorted(int(made[k][p]) for p in at if not gone[k][p])
        want = (near[int((len(near) - 1) / 2 + 0.5)], near[-1], float(sum(near))) if near else (None,) * 3
        assert tuple(o.get((k, x, y)) for o in got) == want
        seen += bool(near)
    assert all(len(o) == seen for o in got)
    flags = r.random((20, 20)) < 0.9
    assert (array_of(tiles.extreme(grid_of(spark, flags, "boolean"), LOPSIDED, "wrap", False, 8)) == around(flags, LOPSIDED, "wrap").min(-1)).all()


def test_rows_dealt_do_not_grow_with_the_taps(spark):
    g = grid_of(spark, np.zeros((128, 128), int))
    n = {w: tiles.dealt(g, stencil.box_kernel(2, w), "clamp", 64).count() for w in (3, 17, 33)}
    assert n[17] < 1.7 * 128 * 128 and n[33] < 2.6 * 128 * 128 and n[33] < 3 * n[3]
    with pytest.raises(ValueError):
        tiles.weighted(g, {})
