"""Pictures of grids with a colour axis: planes by choice of axes, and volumes."""

import numpy as np
import pytest
from helpers import array_of, grid_of

from latticework.operators import render


def test_planes_by_choice_of_axes(spark):
    a = np.random.default_rng(1).integers(0, 256, (4, 7, 3, 6))
    g = grid_of(spark, a)
    got = array_of(render.render_slice(g, (0, 0), (99, 99), 0, 255, axes=(3, 1), fixed={0: 99}, color=2))
    assert (got == a[3].transpose(1, 2, 0)).all()  # channels, axis 3, axis 1
    one = render.render_slice(g, (1, 2), (5, 4), 0, 255, axes=("i1", "i3"), fixed={0: 1, 2: -4})
    assert one.extent == (5, 3) and (array_of(one) == a[1, 1:6, 0, 2:5]).all()
    small = array_of(render.render_slice(g, (0, 0), (6, 5), 0, 255, (3, 3), axes=(1, 3), color=2, reduction="mean"))
    mean = np.round(a[0].mean(1))
    assert small.shape == (1, 4, 3) and abs(int(small[0, 0, 0]) - mean[:2, :2].mean()) <= 1
    assert array_of(render.render_slice(g, (0, 0), (6, 5), 5, 5, axes=(1, 3))).max() == 0
    for wrong in ({"axes": (1, 1)}, {"axes": (2, 3), "color": 2}):
        with pytest.raises(ValueError):
            render.render_slice(g, (0, 0), (2, 2), 0, 255, **wrong)
    with pytest.raises(ValueError):
        render.render_slice(g, (5, 0), (4, 2), 0, 255, axes=(1, 3))


def sampled(volume, c):
    """Linear between cells of the last three axes, cut at the borders."""
    base = np.floor(c).astype(int)
    total = 0.0
    for corner in np.ndindex(2, 2, 2):
        w = np.prod(np.where(corner, c - base, 1 - (c - base)))
        at = np.clip(base + corner, 0, np.array(volume.shape[1:]) - 1)
        total = total + w * volume[(slice(None), *at)]
    return total


@pytest.mark.parametrize("reduction", ["rgb", "max"])
def test_volumes_in_color(spark, reduction):
    r = np.random.default_rng(4)
    a = r.uniform(0, 1.2, (3, 5, 4, 6))
    turn = ((0.8, 0, 0.6), (0, 1, 0), (-0.6, 0, 0.8))
    rays = render.camera_rays(spark, a.shape[1:], 7, 6, turn)
    got = {(q["pixel0"], q["pixel1"]): q for q in render.render_volume(rays, grid_of(spark, a, "double"), 0.4, 40, 0.1, 1.0, "i0", reduction).collect()}
    seen = 0
    for ray in rays.collect():
        o, d = (np.array([ray[f"{x}{k}"] for k in range(3)]) for x in "od")
        dt, color, alpha, met = ray["len"] / 40, np.zeros(3 if reduction == "rgb" else 1), 0.0, False
        for k in range(40):
            c = o + d * k * dt
            if not ((c >= -0.5) & (c <= np.array(a.shape[1:]) - 0.5)).all() or alpha > 0.98:
                continue
            met = True
            value = sampled(a, c)
            value = value if reduction == "rgb" else value.max(keepdims=True)
            value = np.clip((value - 0.1) / 0.9, 0, 1)
            v = value @ [0.299, 0.587, 0.114] if reduction == "rgb" else value[0]
            more = (1 - alpha) * (1 - np.exp(-v * 0.4 * 12 * dt))
            color, alpha = color + more * value, alpha + more
        q = got.get((ray["pixel0"], ray["pixel1"]))
        assert (q is not None) == met
        if met:
            seen += 1
            assert q["alpha"] == pytest.approx(alpha, abs=1e-9) and np.allclose(q["color"], color if reduction == "rgb" else color[0], atol=1e-9)
    assert seen > 20
