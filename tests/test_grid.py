import numpy as np
import pytest
from helpers import array_of, filled, grid_of

from latticework.functions import cells as fn
from latticework.operators import arith, histogram, reduce, stencil
from pyspark.sql import functions as F


def test_views(spark):
    g = grid_of(spark, np.arange(10))
    assert array_of(g.view(3, 7, 2)).tolist() == [3, 5, 7]
    assert array_of(g.view(4, 7, -1)).tolist() == [7, 6, 5, 4]
    assert array_of(g.view(1, 8, -2)).tolist() == [8, 6, 4, 2]
    assert array_of(g.view(-3, -1)).tolist() == [7, 8, 9]
    for bad in ((5, 2, 1), (15, None, 1), (0, 5, 0)):
        with pytest.raises(IndexError):
            g.view(*bad)
    h = grid_of(spark, filled(4, 3))
    assert (array_of(h.mirror(0).mirror(0)) == filled(4, 3)).all()
    assert (array_of(h.swap_axes(0, 1)) == filled(4, 3).T).all()
    assert array_of(h.slice(1, -1)).tolist() == [9, 10, 11, 12]


def test_reductions(spark):
    g = grid_of(spark, filled(4, 3))
    assert tuple(reduce.total(g, "sum", "min", "max", "mean").first()) == (78, 1, 12, 6.5)
    want = {"sum": [10, 26, 42], "min": [1, 5, 9], "max": [4, 8, 12], "mean": [2, 6, 10]}
    for name, values in want.items():
        assert array_of(reduce.along(g, name, 0))[0].tolist() == values
    assert array_of(reduce.along(g, "sum", 1))[:, 0].tolist() == [15, 18, 21, 24]


def test_elementwise(spark):
    a, b = grid_of(spark, np.arange(1, 5)), grid_of(spark, np.full(4, 10))
    assert array_of(arith.arith(a, "+", b)).tolist() == [11, 12, 13, 14]
    assert array_of(arith.arith(a, "%", 3)).tolist() == [1, 2, 0, 1]
    assert array_of(arith.logical_not(grid_of(spark, [0, 1, 5, 0]))).tolist() == [1, 0, 0, 1]
    with pytest.raises(TypeError):
        arith.arith(grid_of(spark, [1.5], "double"), "&", 1)
    d = grid_of(spark, [-50.0, 0, 128, 300, 255], "double")
    assert array_of(d.mapped(fn.to_displayable)).tolist() == [0, 0, 128, 255, 255]
    w = grid_of(spark, [-50.0, 0, 50, 100, 150, 300], "double")
    assert array_of(w.mapped(lambda v: fn.normalize_u8(v, 0, 200))).tolist()[4:] == [191, 255]
    assert arith.holds(a, "<", b).first()[0] and not arith.holds(a, "==", b).first()[0]
    bits = arith.packed(grid_of(spark, np.arange(130) % 3 == 0, "boolean").mapped(lambda v: v.cast("int")))
    assert arith.bit_summary(bits, 130).first()["n"] == 44


def test_stencils(spark):
    g = grid_of(spark, filled(4, 4))
    three = stencil.box_kernel(2, 3)
    out = array_of(stencil.convolve(g, three))
    assert out[1, 1] == 54 and out[0, 0] == 24
    assert (array_of(stencil.convolve(g, {(0, 0): 1.0})) == filled(4, 4)).all()
    h = grid_of(spark, filled(5, 5))
    at = lambda x: array_of(x)[2, 2]
    assert at(stencil.erode(h, three)) == 7 and at(stencil.dilate(h, three)) == 19 and at(stencil.median_filter(h, three)) == 13
    cross = stencil.cross_kernel(2, 3)
    assert at(stencil.erode(h, cross)) == 8 and at(stencil.dilate(h, cross)) == 18
    assert at(stencil.percentile_filter(h, three, 0)) == 7 and at(stencil.percentile_filter(h, three, 100)) == 19
    ramp = grid_of(spark, [[2.0 * x + 3 * y for y in range(6)] for x in range(6)], "double")
    inner = stencil.gradient(ramp).where("i0 = 3 and i1 = 2").first()
    assert (inner["g0"], inner["g1"]) == (2.0, 3.0)
    with pytest.raises(ValueError):
        stencil.box_blur(g, 5)


@pytest.mark.parametrize("border", ["clamp", "wrap", "reflect"])
def test_borders_against_numpy(spark, border):
    a = np.random.default_rng(1).integers(0, 50, (7, 5))
    mode = {"clamp": "edge", "wrap": "wrap", "reflect": "symmetric"}[border]
    p = np.pad(a, 2, mode=mode)
    want = sum(p[i : i + 7, j : j + 5] for i in range(5) for j in range(5))
    assert (array_of(stencil.convolve(grid_of(spark, a), stencil.box_kernel(2, 5), border)) == want).all()


def test_histograms(spark):
    two = np.repeat([50, 200], 1000)
    g = grid_of(spark, two)
    h = {r["bin"]: r["n"] for r in histogram.histogram(g).collect()}
    assert h == {0: 1000, 255: 1000}
    assert 50 <= histogram.otsu(g).first()[0] < 200
    assert sorted(set(array_of(histogram.equalize(g)).tolist())) == [125, 200]
    flat = grid_of(spark, np.full(100, 128))
    assert histogram.otsu(flat).first()[0] == 128 and histogram.two_means(flat) == 128
    assert histogram.k_means(grid_of(spark, [0, 1, 10, 11]), 2) == [0.5, 10.5]
    with pytest.raises(ValueError):
        fn.reduce_channels([F.lit(1)], "phase")
