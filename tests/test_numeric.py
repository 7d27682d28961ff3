"""Solvers, pits and schedules against brute force and analytic cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, inversion, mine
from lodestone.plans import all_queries as registry

SF = "/root/testdata/sf0.01"


def test_maximum_closure_is_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(2, 11))
        profit = rng.integers(-9, 10, n).astype(float)
        src, dst = (np.array(x) for x in zip(*([(a, b) for a in range(n) for b in range(a) if rng.random() < 0.3] or [(0, 0)]), strict=True))
        mined = mine.maximum_closure(profit, src, dst)
        assert all(mined[b] for a, b in zip(src, dst, strict=True) if mined[a])
        best = max(sum(profit[list(c)]) for k in range(n + 1) for c in itertools.combinations(range(n), k) if all(b in c for a, b in zip(src, dst, strict=True) if a in c))
        assert profit[mined].sum() == pytest.approx(best)


def test_pits_are_closed_and_grow_with_price(spark):
    phases = {r.voxel_id: r.phase for r in registry.QUERIES["pit_phases"](spark, SF).collect()}
    arcs = registry.QUERIES["precedence_arcs"](spark, SF).collect()
    assert all(phases.get(r.dst, 9) <= phases[r.src] for r in arcs if r.src in phases)
    sweep = registry.QUERIES["price_sweep"](spark, SF).orderBy("price").collect()
    assert all(a.blocks <= b.blocks and a.profit <= b.profit + 1e-6 for a, b in zip(sweep, sweep[1:], strict=False))


def test_schedule_keeps_order_and_capacity(spark):
    rows = spark.createDataFrame([(1, i, i % 3, i % 4, 10.0 + i % 5, float(i % 7 - 3)) for i in range(60)], "run int, voxel_id long, phase int, iy int, tonnage double, profit double")
    got = {r.voxel_id: r.year for r in mine.schedule(rows, 50.0, 25.0).collect()}
    ordered = sorted(rows.collect(), key=lambda r: (r.phase, r.iy, -r.profit / r.tonnage, r.voxel_id))
    years = [got[r.voxel_id] for r in ordered]
    assert years == sorted(years) and years[0] == 1
    for y in set(years):
        own = [r for r in ordered if got[r.voxel_id] == y]
        assert sum(r.tonnage for r in own) <= 50.0 and sum(r.tonnage for r in own if r.profit > 0) <= 25.0


def test_schedule_as_a_fold(spark):
    """Three runs with blocks of no tonnage and above both capacities, block by block."""
    rng = np.random.default_rng(11)
    rows = []
    for run, n, most in ((1, 150, 9), (2, 40, 70), (3, 1, 5)):
        for i in range(n):
            t = float(rng.integers(0, most)) if rng.random() < 0.9 else 0.0
            rows.append((run, i, int(rng.integers(0, 3)), int(rng.integers(0, 4)), t, float(rng.integers(-3, 4))))
    df = spark.createDataFrame(rows, "run int, voxel_id long, phase int, iy int, tonnage double, profit double")
    want = {}
    for run in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[3], -(r[5] / r[4] if r[4] > 0 else 0.0), r[1]))
        year, mine_left, plant_left = 1, 50.0, 25.0
        for _, k, _, _, t, profit in own:
            if mine_left < t or (profit > 0 and plant_left < t):
                year, mine_left, plant_left = year + 1, 50.0, 25.0
            mine_left -= t
            plant_left -= t if profit > 0 else 0.0
            want[run, k] = year
    assert {(r.run, r.voxel_id): r.year for r in mine.schedule(df, 50.0, 25.0).collect()} == want
    assert mine.schedule(df.limit(0), 50.0, 25.0).collect() == []


def test_fleet_is_repeatable_and_bounded(spark):
    a, b = (sorted(map(tuple, registry.QUERIES["fleet_simulation"](spark, SF).collect())) for _ in range(2))
    assert a == b and all(0 < trips <= 480 / (3.0 * 0.9) + 1 for _, trips in a)


def _problem(spark, n_obs=12, n=30, seed=3):
    rng = np.random.default_rng(seed)
    g, m = rng.normal(size=(n_obs, n)), rng.normal(size=n)
    kernel = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(n_obs) for j in range(n)], "obs_id long, voxel_id long, val double")
    data = spark.createDataFrame([(i, float(x)) for i, x in enumerate(g @ m)], "obs_id long, d double")
    return g, g @ m, kernel, data


def test_least_squares_as_the_normal_equations(spark):
    g, d, kernel, data = _problem(spark)
    want = np.linalg.solve(g.T @ g + 0.25 * np.eye(g.shape[1]), g.T @ d)
    got = {r.voxel_id: r.m for r in inversion.cgls(kernel, data, 0.5).collect()}
    assert np.allclose([got[i] for i in range(len(want))], want, atol=1e-5)
    direct = {r.voxel_id: r.m for r in inversion.solve_in_data_space(kernel, data, 0.5).collect()}
    assert np.allclose([direct[i] for i in range(len(want))], want, atol=1e-9)


def test_both_sides_of_the_size_agree(spark):
    """One task or joins: the same model, sweep and regularised cases."""
    g, d, kernel, data = _problem(spark, 8, 12)
    for few in (0, 100):
        got = {r.voxel_id: r.m for r in inversion.damped(kernel, data, 0.5, few).collect()}
        assert np.allclose([got[i] for i in range(12)], np.linalg.solve(g.T @ g + 0.25 * np.eye(12), g.T @ d), atol=1e-6)
    a, b = ([tuple(r) for r in inversion.sweep(kernel, data, [0.5, 2.0], few).orderBy("damping").collect()] for few in (0, 100))
    assert np.allclose(a, b, rtol=1e-5)


@pytest.mark.parametrize("sizes", [{}, {"most_kernel": 0}, {"most_cells": 0}])
def test_regularised_cases_as_the_normal_equations(spark, sizes):
    """Cases in tasks, in passes over blocks, as joins."""
    n, cases = 9, [(1, 0.5, 0.0, 0.0), (2, 1.0, 2.0, 0.3)]
    g, d, kernel, data = _problem(spark, 6, n)
    sigma, w = 0.5 + np.arange(6) / 10, 1 + np.arange(n) / 5
    edges = [(i, i + 1) for i in range(n - 1)]
    out = inversion.regularised(
        kernel, spark.createDataFrame([(i, float(x), float(s)) for i, (x, s) in enumerate(zip(d, sigma, strict=True))], "obs_id long, d double, sigma double"), spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "voxel_id long, w double"),
        spark.createDataFrame(edges, "src long, dst long"), cases, **sizes, lower=-1.0, upper=1.0,
        penalty=inversion.edge_penalty(spark.createDataFrame([(0, 4, 1.5), (2, 7, 0.5)], "src long, dst long, weight double")), pull=spark.createDataFrame([(3, 0.7), (8, -0.2)], "voxel_id long, b double"),
    )
    got = {(r.case_id, r.voxel_id): r.m for r in out.collect()}
    lap = np.zeros((n, n))
    for i, j in edges:
        lap[[i, j], [i, j]] += 1
        lap[[i, j], [j, i]] -= 1
    mixed = np.zeros((n, n))
    for i, j, weight in ((0, 4, 1.5), (2, 7, 0.5)):
        mixed[[i, j], [i, j]] += weight**2
        mixed[[i, j], [j, i]] -= weight**2
    for case, lam, alpha, ref in cases:
        gw = g / sigma[:, None]
        left = gw.T @ gw + lam**2 * np.diag(w**2) + alpha**2 * lap + mixed
        want = ref + np.linalg.solve(left, gw.T @ (d / sigma - ref * gw.sum(1)) + np.array([0, 0, 0, 0.7, 0, 0, 0, 0, -0.2]))
        assert np.allclose([got[case, i] for i in range(n)], np.clip(want, -1, 1), atol=1e-6)


def test_chosen_damping_and_depth_of_investigation(spark):
    fit = registry.QUERIES["chi2_choice"](spark, SF).first()
    assert fit["lambda"] > 0 and fit["misfit_percent"] < 100
    doi = [r.doi for r in registry.QUERIES["doi_index"](spark, SF).collect()]
    assert min(doi) >= 0 and 0.9 < max(doi) < 1.2 and min(doi) < 0.5


def test_damping_sweep_is_an_l_curve(spark):
    g, d, kernel, data = _problem(spark)
    rows = inversion.sweep(kernel, data, [0.1, 1.0, 10.0]).orderBy("damping").collect()
    assert rows[0].misfit < rows[1].misfit < rows[2].misfit and rows[0].norm > rows[2].norm
    x = np.linalg.solve(g.T @ g + np.eye(g.shape[1]), g.T @ d)
    assert rows[1].misfit == pytest.approx(np.linalg.norm(d - g @ x), rel=1e-6) and rows[1].norm == pytest.approx(np.linalg.norm(x), rel=1e-6)


def test_posterior_deviation(spark):
    g, _, kernel, _ = _problem(spark, 12, 8)
    want = np.sqrt(np.diag(np.linalg.inv(g.T @ g + 25.0 * np.eye(8))))
    got = {r.voxel_id: r.std for r in inversion.posterior_std(kernel, 5.0, probes=200).collect()}
    assert np.allclose([got[i] for i in range(8)], want, rtol=0.15)
    one, other = ({r.voxel_id: r.std for r in inversion.posterior_std(kernel, 5.0, probes=3, **n).collect()} for n in ({}, {"most_kernel": 0}))
    joined = {r.voxel_id: r.std for r in inversion.posterior_std(kernel, 5.0, probes=3, most_cells=0).collect()}
    assert all(one[i] == pytest.approx(other[i], abs=1e-7) == pytest.approx(joined[i], abs=1e-7) for i in range(8))


def test_upward_continuation_of_a_harmonic(spark):
    n, step, height = 32, 10.0, 25.0
    k = 2 * math.pi * 2 / (n * step)
    rows = [(0, r, c, math.cos(k * c * step)) for r in range(n) for c in range(n)]
    out = inversion.upward_continuation(spark.createDataFrame(rows, "survey int, row long, col long, g double"), step, height)
    assert all(abs(r.g - math.exp(-k * height) * math.cos(k * r.col * step)) < 1e-9 for r in out.collect())


def test_sphere_is_recovered(spark):
    row = registry.QUERIES["sphere_recovery"](spark, SF).first()
    assert row.n_voxels == 256 and row.n_obs == 49
    assert row.pearson >= 0.85 and row.misfit_percent < 5


def test_focusing_in_one_task_or_by_joins(spark):
    g, d, kernel, data = _problem(spark, 6, 10)
    weights = spark.createDataFrame([(i, 1.0 + i / 10) for i in range(10)], "voxel_id long, w double")
    one, other = ({r.voxel_id: r.m for r in inversion.focused(kernel, data, weights, 0.1, 2, 5.0, n).collect()} for n in (0, 1000))
    assert all(one[i] == pytest.approx(other[i], abs=1e-8) for i in range(10))


def test_running_sums_by_ranges(spark):
    from lodestone.operators.profile import running_sums

    df = spark.createDataFrame([(float(i * 7 % 101), i) for i in range(101)], "s double, k long")
    total = 0
    for r in running_sums(df, "s", ["k"], 5).orderBy(F.desc("s")).collect():
        total += r.k
        assert r.k_sum == total


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_polynomial_trend_as_least_squares(spark, order):
    from lodestone.operators.profile import polynomial_trend

    rng = np.random.default_rng(order)
    x, z, g = rng.uniform(100, 900, 200), rng.uniform(-5, 5, 200), rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, g, strict=True))], "k long, x double, z double, g double")
    u, v = (x - x.min()) / (x.max() - x.min()), (z - z.min()) / (z.max() - z.min())
    m = np.stack([u**i * v**j for i in range(order + 1) for j in range(order + 1 - i)], 1)
    want = g - m @ np.linalg.lstsq(m, g, rcond=None)[0]
    got = {r.k: r.residual for r in polynomial_trend(df, "x", "z", "g", order).collect()}
    assert np.allclose([got[i] for i in range(200)], want, atol=1e-6)


def test_near_pairs_meet_once(spark):
    from lodestone.operators.profile import near_pairs

    rng = np.random.default_rng(2)
    at = rng.integers(0, 6, (60, 3)) / 2
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "id long, x double, y double, z double")
    want = sorted((i, j) for i in range(60) for j in range(i) if 0 < np.linalg.norm(at[i] - at[j]) <= 1.0)
    assert sorted((r.i, r.j) for r in near_pairs(df, "id", ["x", "y", "z"], 1.0).collect()) == want


def test_cross_gradient_is_zero_for_parallel_fields(spark):
    from lodestone.sources import adapters

    v = adapters.voxels(spark, SF).withColumn("twice", F.col("density") * 2 + 1)
    assert inversion.cross_gradient(v, "density", "twice", 25.0).agg(F.max("cross")).first()[0] < 1e-9


def test_cross_penalty_is_the_cross_product(spark):
    rng = np.random.default_rng(7)
    shape, size = (3, 4, 2), 5.0
    a, m = rng.normal(size=shape), rng.normal(size=shape)
    cells = [(int(np.ravel_multi_index(p, shape)), *p, float(a[p])) for p in np.ndindex(*shape)]
    q = np.zeros((24, 24))
    for r in inversion.cross_penalty(spark.createDataFrame(cells, "voxel_id long, ix int, iy int, iz int, v double"), "v", size, 3.0).collect():
        q[r.i, r.j] += r.q
    ga, gm = (np.stack(np.gradient(f, size)) for f in (a, m))
    cross = np.cross(gm, ga / np.sqrt((ga**2).sum(0) + 1e-12), axis=0)
    assert m.ravel() @ q @ m.ravel() == pytest.approx(9 * (cross**2).sum(), rel=1e-9)
    assert np.allclose(q, q.T) and np.allclose(q.sum(1), 0, atol=1e-12)


def test_joint_inversion_draws_structures_together(spark):
    history = registry.QUERIES["joint_history"](spark, SF).orderBy("round").collect()
    assert history[0].round == 0 and history[0].factor == 0 and history[-1].stop
    assert history[1].factor == pytest.approx(200 * (1 - math.exp(-0.25)))
    assert history[-1].e_cell < 0.8 * history[0].e_cell and 0 <= history[-1].e_l2 <= history[-1].e_cell + 1


def test_sized_kernel_as_the_one_of_equal_cells(spark):
    from lodestone.operators import spatial
    from lodestone.sources import adapters

    s, v = adapters.sensors(spark, SF), adapters.voxels(spark, SF)
    boxes = v.select("voxel_id", *[(F.col(a) + h).alias(f"{a}{e}") for a in "xyz" for e, h in ((0, -12.5), (1, 12.5))])
    got = spatial.sized_kernel(s, boxes, 120.0).withColumnRenamed("val", "other").join(spatial.gravity_kernel(s, v, 25.0, 120.0), ["obs_id", "voxel_id"], "full")
    row = got.agg(F.max(F.abs(F.col("val") - F.col("other")) / F.abs("val")).alias("off"), F.count(F.when(F.col("val").isNull() | F.col("other").isNull(), 1)).alias("alone")).first()
    assert row.off < 1e-6 and row.alone == 0


def test_octree_inversion_explains_the_data(spark):
    m = registry.QUERIES["octree_inversion"](spark, SF).agg(F.min("contrast"), F.max("contrast"), F.count("*")).first()
    assert -0.6 <= m[0] < m[1] <= 1.6 and m[2] == registry.QUERIES["octree_split"](spark, SF).count()


def test_regional_and_residual_of_stations(spark):
    def parts(f):
        rows = [(1, r * 40 + c, c * 500.0, r * 500.0, float(f(c, r))) for r in range(40) for c in range(40)]
        out = inversion.regional_residual(spark.createDataFrame(rows, "survey int, obs_id long, x double, z double, g double"), 500.0, 2000.0).collect()
        assert len(out) == 1600
        return {divmod(r.obs_id, 40): (r.regional, r.residual) for r in out}

    assert all(abs(a - 7) < 1e-6 and abs(b) < 1e-6 for a, b in parts(lambda c, r: 7.0).values())
    wave = parts(lambda c, r: math.cos(math.pi * c / 2))  # of 2000 m: hardly anything is left 2000 m up
    inside = [(wave[r, c], math.cos(math.pi * c / 2)) for r in range(10, 30) for c in range(10, 30)]
    assert all(abs(a) < 0.02 and abs(b - g) < 0.1 for (a, b), g in inside)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (5, 5)], "src long, dst long")
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000, 1002: 1000}


def test_utm_round_trip(spark):
    df = registry.QUERIES["utm_roundtrip"](spark, SF)
    errors = [c for c, kind in df.dtypes if "err" in c]
    for c in errors:
        assert df.agg(F.max(F.abs(c))).first()[0] < 1e-3
