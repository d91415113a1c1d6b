"""Small systems and decompositions in columns, projections of points, flow of volumes."""

import numpy as np
import pytest
from helpers import array_of, grid_of
from pyspark.sql import functions as F

from latticework.operators import arith, flow, linalg, tomography


def matrices(spark, x):
    return spark.createDataFrame([(k, None if m is None else np.ravel(m).tolist()) for k, m in enumerate(x)], "id bigint, m array<double>")


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_decompositions(spark, n):
    r = np.random.default_rng(n)
    x = [*r.normal(size=(20, n, n)), np.zeros((n, n)), np.outer(np.arange(1, n + 1), np.ones(n)), None]
    got = {q["id"]: q["e"] for q in matrices(spark, x).select("id", linalg.decomposition(F.col("m"), n).alias("e")).collect()}
    assert got[22] is None or got[22]["u"] is None
    for k, m in enumerate(x[:-1]):
        u, v, s = np.reshape(got[k]["u"], (n, n)), np.reshape(got[k]["v"], (n, n)), np.array(got[k]["s"])
        for q in (u, v):
            assert np.abs(q.T @ q - np.eye(n)).max() < 1e-9
        assert np.abs(u @ np.diag(s) @ v.T - m).max() < 1e-9 and (np.diff(s) <= 0).all()
        assert got[k]["rank"] == np.linalg.matrix_rank(m) and got[k]["norm"] == pytest.approx(s[0])
        assert got[k]["cond"] == (pytest.approx(np.linalg.cond(m)) if got[k]["rank"] == n else pytest.approx(got[k]["cond"])) and (got[k]["rank"] == n or got[k]["cond"] > 1e12)
        assert all(v[np.argmax(np.round(np.abs(v[:, c]), 12)), c] > 0 for c in range(n))


def test_eigenvectors(spark):
    r = np.random.default_rng(2)
    x = [m + m.T for m in r.normal(size=(15, 4, 4))] + [np.eye(4), None]
    for q in matrices(spark, x).select("id", linalg.eigen(F.col("m"), 4).alias("e")).collect():
        if x[q["id"]] is None:
            continue
        values, vectors = np.array(q["e"]["values"]), np.reshape(q["e"]["vectors"], (4, 4))
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-9 and (np.diff(values) <= 1e-12).all()
        assert np.abs(x[q["id"]] @ vectors - vectors * values).max() < 1e-9


@pytest.mark.parametrize("n", [2, 3, 6])
def test_systems(spark, n):
    r = np.random.default_rng(n)
    a, b = r.normal(size=(30, n, n)), r.normal(size=(30, n))
    a[3, 0, 0] = 0  # needs another pivot
    a[7] = np.outer(a[7, 0], a[7, 1])
    rows = [(k, a[k].ravel().tolist(), b[k].tolist()) for k in range(30)] + [(30, None, b[0].tolist())]
    df = spark.createDataFrame(rows, "id bigint, a array<double>, b array<double>")
    got = {q["id"]: q["x"] for q in df.select("id", linalg.solve(F.col("a"), F.col("b"), n).alias("x")).collect()}
    assert got[7] is None and got[30] is None
    assert all(np.allclose(got[k], np.linalg.solve(a[k], b[k])) for k in range(30) if k != 7)


def test_projection_of_points_and_its_slopes(spark):
    m = linalg.cone_view(0.4, 50.0, 20.0, (9, 7), (12, 12, 12))
    p = np.array([3.0, 5.5, 7.0])
    df = spark.createDataFrame([(m.ravel().tolist(), *p.tolist())], "m array<double>, x double, y double, z double")
    point = [F.col(c) for c in "xyz"]
    place = df.select(*[c.alias(f"u{k}") for k, c in enumerate(linalg.project_point(F.col("m"), point))]).first()
    on = lambda q: (m @ np.append(q, 1))[:2] / (m @ np.append(q, 1))[2]
    assert np.allclose(place, on(p))
    slopes = linalg.projection_slopes(F.col("m"), point)
    got = df.select(*[c.alias(f"s{r}{k}") for r, row in enumerate(slopes) for k, c in enumerate(row)]).first()
    want = np.stack([(on(p + h) - on(p - h)) / 2e-5 for h in np.eye(3) * 1e-5], 1)
    assert np.allclose(np.reshape(got, (2, 3)), want, atol=1e-6)


def test_flow_of_volumes(spark):
    at = np.stack(np.meshgrid(np.arange(14), np.arange(12), np.arange(13), indexing="ij"), -1).astype(float)
    bright = lambda c: 90 + 40 * np.sin(c[..., 0] * 0.5 + 1) * np.cos(c[..., 1] * 0.45) + 30 * np.sin(c[..., 2] * 0.55 + c[..., 0] * 0.2)
    move = np.array([0.4, -0.3, 0.5])
    rows = flow.lucas_kanade(grid_of(spark, bright(at), "double"), grid_of(spark, bright(at - move), "double"), 3).collect()
    inner = [(r["u0"], r["u1"], r["u2"]) for r in rows if all(3 <= r[f"i{k}"] < n - 3 for k, n in enumerate((14, 12, 13)))]
    assert len(rows) == 14 * 12 * 13 and np.abs(np.mean(inner, 0) - move).max() < 0.1
    assert np.mean(np.abs(np.array(inner) - move).max(1) < 0.3) > 0.95
    flat = flow.lucas_kanade(grid_of(spark, np.ones((4, 4, 4)), "double"), grid_of(spark, np.ones((4, 4, 4)), "double"), 1).collect()
    assert all(r["u0"] == r["u1"] == r["u2"] == 0 for r in flat)


def test_values_column_after_column(spark):
    m = np.arange(9.0).reshape(3, 3)
    assert (linalg.from_column_major(m.T.ravel(), 3) == m).all()
    rows = spark.createDataFrame([(m.T.ravel().tolist(),), (None,)], "c array<double>")
    assert [r[0] for r in rows.select(linalg.rows_of_column_major(F.col("c"), 3)).collect()] == [m.ravel().tolist(), [None] * 9]


@pytest.mark.parametrize("extent", [(31, 40), (9, 11, 10)])
def test_head_phantom(spark, extent):
    got = array_of(tomography.head_phantom(spark, extent))
    at = np.meshgrid(*[np.linspace(-1, 1, n) for n in extent], indexing="ij")
    want, d = np.zeros(extent), len(extent)
    for flat, solid, *rest, turn in tomography.HEAD:
        x, y = at[0] - rest[0], -at[1] - rest[1]
        c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
        far = ((x * c + y * s) / rest[3]) ** 2 + ((y * c - x * s) / rest[4]) ** 2
        far = far if d == 2 else far + ((at[2] - rest[2]) / rest[5]) ** 2
        want += np.where(far <= 1, flat if d == 2 else solid, 0.0)
    assert (np.abs(got - want) < 1e-9).mean() > 0.995  # cells right on a border may fall either way
    with pytest.raises(ValueError):
        tomography.head_phantom(spark, (4,))


def test_torus(spark):
    turn = (linalg.rotate(3, 2, 0, 0.4) @ linalg.rotate(3, 1, 2, 0.6))[:3, :3]
    got = array_of(tomography.torus(spark, (12, 10, 14), turn, (0.0, 0.2, 0.0)))
    at = np.stack(np.meshgrid(*[(np.arange(n) + 0.5) / n * 2 - 1 for n in (12, 10, 14)], indexing="ij"), -1) - [0, 0.2, 0]
    x, y, z = np.moveaxis(at @ turn, -1, 0)
    f = np.clip(1 - (np.hypot(np.hypot(x, z) - 0.35, y) - 0.14) / 0.12, 0, 1)
    assert np.abs(got - np.floor(f * f * 255)).max() <= 1 and got.max() == 255


def test_noise_of_channels_falls_together(spark):
    g = grid_of(spark, np.full((3, 20, 20), 7))
    got = array_of(arith.salt_and_pepper(g, 0.2, 0, 255, 3, together=("i0",)))
    assert (got == got[0]).all() and set(np.unique(got)) == {0, 7, 255}
    assert 0.1 < (got[0] != 7).mean() < 0.3
    assert (got == array_of(arith.salt_and_pepper(g, 0.2, 0, 255, 3, together=("i0",)))).all()
    assert (got != array_of(arith.salt_and_pepper(g, 0.2, 0, 255, 4, together=("i0",)))).any()
    assert (array_of(arith.salt_and_pepper(g, 0.0, 0, 255)) == 7).all() and (array_of(arith.salt_and_pepper(g, 1.0, 0, 255)) != 7).all()
