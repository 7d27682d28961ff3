"""Packed kernels: products, bounds and shifts against dense algebra."""

import numpy as np
import pytest

from lodestone.operators import blocks as B
from lodestone.operators import inversion
from lodestone.plans import all_queries as registry

SF = "/root/testdata/sf0.01"


def _tables(spark, rng, n_obs=14, n=30, share=0.5):
    g = rng.normal(size=(n_obs, n)) * (rng.random((n_obs, n)) < share)
    d, sigma = rng.normal(size=n_obs), 0.5 + rng.random(n_obs)
    kernel = spark.createDataFrame([(i, 3 * j, float(g[i, j])) for i in range(n_obs) for j in range(n) if g[i, j]], "obs_id long, voxel_id long, val double")
    data = spark.createDataFrame([(i, float(x), float(s)) for i, (x, s) in enumerate(zip(d, sigma, strict=True))], "obs_id long, d double, sigma double")
    return g / sigma[:, None], d / sigma, kernel, data


def _edges(spark, n):
    return spark.createDataFrame([(3 * i, 3 * i + 3) for i in range(n - 1)], "src long, dst long")


@pytest.mark.parametrize("block", [1, 20, 1 << 18])
def test_products_of_blocks(spark, monkeypatch, block):
    """Passes over a table and arrays in memory give G'G X, G'd, the columns' squares and the misfits, however rows are cut into blocks."""
    monkeypatch.setattr(B, "BLOCK", block)
    g, d, kernel, data = _tables(spark, np.random.default_rng(4))
    own = B.Blocks(kernel, data, np.arange(0, 90, 3))
    x = np.random.default_rng(5).normal(size=(30, 3))
    rows = [tuple(map(bytes, r)) for r in own.frame.select("starts", "cells", "numbers", "data").collect()]
    for operator in (B.Passes(30, own.frame), B.Arrays(30, rows)):
        assert np.allclose(operator.times(x), g.T @ g @ x)
        assert np.allclose(operator.start(), [g.T @ d, (g**2).sum(0), g.sum(0)])
        assert np.allclose(operator.misfits(x), ((d[:, None] - g @ x) ** 2).sum(0))


@pytest.mark.parametrize("seed", range(6))
def test_bounds_against_all_faces(seed):
    """The least in a box, against every choice of held cells."""
    import itertools

    rng = np.random.default_rng(seed)
    n = 6
    a = rng.normal(size=(8, n))
    matrix, rhs = a.T @ a + 0.1 * np.eye(n), 3 * rng.normal(size=n)
    lower, upper = -rng.random(n), rng.random(n)
    lower[1] = upper[1] = 0.3
    got = B.within_bounds(lambda x: matrix @ x, rhs, np.diag(matrix).copy(), lower, upper)
    assert got[1] == 0.3 and (got >= lower).all() and (got <= upper).all()
    best, f = None, lambda x: x @ matrix @ x / 2 - rhs @ x
    for held in itertools.product((0, 1, 2), repeat=n):
        at, x = np.array(held), np.where(np.array(held) == 1, lower, upper)
        free = at == 0
        if free.any():
            x[free] = np.linalg.solve(matrix[np.ix_(free, free)], rhs[free] - matrix[np.ix_(free, ~free)] @ x[~free])
        if (x >= lower - 1e-12).all() and (x <= upper + 1e-12).all() and (best is None or f(x) < best):
            best = f(x)
    assert f(got) == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_bounded_keeps_anchors_and_signs(spark, most):
    """Fixed cells keep their value to the last bit; slopes at the bounds have the right signs; in tasks and in passes."""
    g, d, kernel, data = _tables(spark, np.random.default_rng(7))
    w = 1 + np.arange(30) / 10
    fixed = {4: 0.123456789, 17: -0.3}
    rows = [(3 * i, float(w[i]), fixed.get(i, 0.0), fixed.get(i, 0.25), fixed.get(i)) for i in range(30)]
    cells = spark.createDataFrame(rows, "voxel_id long, w double, lower double, upper double, target double")
    m = inversion.bounded(kernel, data, cells, _edges(spark, 30), 0.4, 0.7, most_kernel=most)
    got = np.array([r.m for r in m.orderBy("voxel_id").collect()])
    assert all(got[i] == v for i, v in fixed.items())
    lap = sum((np.outer(v, v) for v in (np.eye(30)[i] - np.eye(30)[i + 1] for i in range(29))), np.zeros((30, 30)))
    target = np.array([fixed.get(i, 0.0) for i in range(30)])
    slope = g.T @ (g @ got - d) + 0.16 * w**2 * (got - target) + 0.49 * lap @ got
    moves = np.array([i not in fixed for i in range(30)])
    assert (np.abs(slope[moves & (got > 0) & (got < 0.25)]) < 1e-6).all()
    assert (slope[moves & (got == 0)] > -1e-6).all() and (slope[moves & (got == 0.25)] < 1e-6).all()
    assert (got[moves] == 0).any() and (got[moves] == 0.25).any()
    by_join = inversion.objective_slopes(kernel, data, cells, _edges(spark, 30), m, 0.4, 0.7).orderBy("voxel_id").collect()
    assert np.allclose([r.slope for r in by_join], slope)
    one = inversion.objective(kernel, data, cells, _edges(spark, 30), m, 0.4, 0.7).first()
    assert one.objective == pytest.approx(((d - g @ got) ** 2).sum() + 0.16 * (w**2 * (got - target) ** 2).sum() + 0.49 * got @ lap @ got)


def test_shifts_share_their_products():
    """All dampings as if solved alone, with the products of the smallest one."""
    rng = np.random.default_rng(2)
    g = rng.normal(size=(25, 60))
    matrix, rhs, used = g.T @ g, g.T @ rng.normal(size=25), [0]

    def times(x):
        used[0] += 1
        return matrix @ x

    dampings = np.array([3.0, 0.1, 30.0, 1.0, 0.3, 10.0, 100.0])
    x, condition = B.shifted(times, rhs, dampings**2)
    many, used[0] = used[0], 0
    B.shifted(times, rhs, dampings[1:2] ** 2)
    assert many == used[0]
    for k, a in enumerate(dampings):
        assert np.allclose(x[:, k], np.linalg.solve(matrix + a * a * np.eye(60), rhs), atol=1e-6)
    values = np.linalg.eigvalsh(g @ g.T)
    assert condition == pytest.approx(np.sqrt((values[-1] + dampings**2) / (values[0] + dampings**2)), rel=1e-3)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_krylov_cases(spark, most):
    g, d, kernel, data = _tables(spark, np.random.default_rng(9))
    w = 1 + np.arange(30) / 10
    cells = spark.createDataFrame([(3 * i, float(x)) for i, x in enumerate(w)], "voxel_id long, w double")
    dampings = [0.2, 1.0, 5.0, 1e-9]
    models, fits = inversion.krylov_cases(kernel, data, cells, _edges(spark, 30), 0.7, dampings[:3], most_kernel=most)
    lap = sum((np.outer(v, v) for v in (np.eye(30)[i] - np.eye(30)[i + 1] for i in range(29))), np.zeros((30, 30)))
    own = {(r.case_id, r.voxel_id): r.m for r in models.collect()}
    for r in fits.collect():
        want = np.linalg.solve(g.T @ g + r.damping**2 * np.diag(w**2) + 0.49 * lap, g.T @ d)
        assert np.allclose([own[r.case_id, 3 * i] for i in range(30)], want, atol=1e-6)
        assert r.misfit == pytest.approx(np.linalg.norm(d - g @ want), rel=1e-5) and r.norm == pytest.approx(np.linalg.norm(w * want), rel=1e-5) and not r.refused
    _, strict = inversion.krylov_cases(kernel, data, cells, _edges(spark, 30), 0.7, dampings[:3], most_condition=3.0, most_kernel=most)
    seen = {r.damping: (r.condition, r.refused) for r in strict.collect()}
    assert all(refused == (condition > 3) for condition, refused in seen.values()) and {r for _, r in seen.values()} == {True, False}


def test_bounded_inversion_differs_from_the_clipped_model(spark):
    m = registry.QUERIES["bounded_inversion"](spark, SF)
    values = [r.contrast for r in m.collect()]
    assert any(v is None for v in values) and all(v is None or -0.2 <= v <= 1.6 for v in values)
