"""Focusing, kept kernels, bodies of two properties, favourability of runs, best iterations: by hand and by brute force."""

import itertools
from pathlib import Path

import numpy as np
import pytest

from lodestone.operators import audit, focusing, graph
from lodestone.operators import spatial as S
from lodestone.sources import kernels

# --- focusing ---


def _by_hand(g, d, y, edges, base, alpha):
    """All rounds by dense algebra."""
    n = g.shape[1]
    scale = np.abs(g).max()
    gn, dn = g / scale, d / scale
    w = np.maximum(y, 1e-3) ** 0.5
    w /= w.mean()
    lap = np.zeros((n, n))
    for a, b in edges:
        lap[[a, b], [a, b]] += 1
        lap[[a, b], [b, a]] -= 1
    lap /= 6
    smooth = alpha * len(d) / n
    m, eps, rounds = np.clip(base, 0, 1.6), 0.8, []
    for _ in range(10):
        x = m / w
        f = np.clip(1 / np.sqrt(np.maximum(x**2 + eps**2, (0.12 / w) ** 2)), 0, 1 / 0.12)
        left = np.diag(w) @ (gn.T @ gn + smooth**2 * lap.T @ lap) @ np.diag(w) + 0.01 * np.diag(f**2)
        new = np.clip(np.linalg.solve(left, w * (gn.T @ dn)) * w, 0, 1.6)
        delta = np.linalg.norm(new - m) / max(np.linalg.norm(new), 1e-9)
        rounds.append((eps, delta, np.sqrt(np.mean((d - g @ new) ** 2)), new))
        m, eps = new, max(0.9 * eps, 0.12)
        if delta < 1e-3:
            break
    return rounds


@pytest.mark.parametrize(("seed", "most"), [(1, 1 << 20), (2, 0)])
def test_focusing_round_by_round(spark, seed, most):
    rng = np.random.default_rng(seed)
    n, n_obs = 24, 9
    y = np.repeat([12.5, 37.5, 62.5], 8)
    g = rng.random((n_obs, n)) * 3 / y
    truth = np.zeros(n)
    truth[[9, 10]] = 1.0
    d = g @ truth + 0.01 * rng.normal(size=n_obs)
    base, edges = np.clip(rng.normal(0.3, 0.3, n), 0, 2), [(i, i + 1) for i in range(n - 1)]
    kernel = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(n_obs) for j in range(n)], "obs_id long, voxel_id long, val double")
    data = spark.createDataFrame([*[(i, float(x)) for i, x in enumerate(d)], (99, 0.5)], "obs_id long, d double")  # the last one sees nothing
    model = spark.createDataFrame([(i, float(x)) for i, x in enumerate(base)], "voxel_id long, m double")
    before = sorted(model.collect())
    got = focusing.focusing(kernel, data, spark.createDataFrame([(i, float(x)) for i, x in enumerate(y)], "voxel_id long, y double"), spark.createDataFrame(edges, "src long, dst long"), model, most_kernel=most)
    want = _by_hand(np.vstack([g, np.zeros(n)]), np.append(d, 0.5), y, edges, base, 2.0)
    history = got.history.orderBy("round").collect()
    assert [r.eps for r in history] == pytest.approx([w[0] for w in want]) and [r.delta for r in history] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert [r.rms for r in history] == pytest.approx([w[2] for w in want], abs=1e-6)
    state, best = got.state.first(), int(np.argmin([w[2] for w in want]))
    assert state.best_round == best and state.rounds == len(want) and state.converged == (want[-1][1] < 1e-3)
    assert np.allclose([r.m for r in got.model.orderBy("voxel_id").collect()], want[best][3], atol=1e-6)
    assert sorted(model.collect()) == before  # the base model isn't changed


def test_scale_states():
    assert [focusing.scale_state(m, b) for m, b in ((1.6, 1.0), (0.1, 0.5), (0.2, 0.5), (0.1, 0.0), (0.7, 0.0))] == ["UNSTABLE", "SUPPRESSED", "OK", "SUPPRESSED", "OK"]


def test_focusing_needs_a_kernel(spark):
    none = spark.createDataFrame([], "obs_id long, voxel_id long, val double")
    one = spark.createDataFrame([(0, 1.0)], "voxel_id long, y double")
    with pytest.raises(ValueError):
        focusing.focusing(none, spark.createDataFrame([(0, 1.0)], "obs_id long, d double"), one, spark.createDataFrame([], "src long, dst long"), one.withColumnRenamed("y", "m"))


# --- kept kernels ---


def test_kept_kernel_is_read_back(spark, tmp_path):
    """A second reading makes no kernel; a moved sensor makes one batch; another grid or parameter makes all; rows are those of the kernel."""
    sensors = spark.createDataFrame([(i, 10.0 * i, -1.0, 7.0 * (i % 5)) for i in range(20)], "obs_id long, x_m double, y_m double, z_m double")
    cells = spark.createDataFrame([(i, 25.0 * (i % 8) + 12.5, 25.0 * (i // 8) + 12.5, 12.5) for i in range(40)], "voxel_id long, x double, y double, z double")
    calls, path = [], f"file://{tmp_path}/kernel"

    def make(s, c):
        calls.append(sorted(r.obs_id for r in s.collect()))
        return S.gravity_kernel(s, c, 25.0, 80.0)

    rows = lambda df: sorted((r.obs_id, r.voxel_id, round(r.val * 1e12, 6)) for r in df.collect())
    first, made = kernels.kept_kernel(sensors, cells, make, path, "p", 4)
    assert made == [0, 1, 2, 3] and rows(first) == rows(S.gravity_kernel(sensors, cells, 25.0, 80.0))
    again, made = kernels.kept_kernel(sensors, cells, make, path, "p", 4)
    assert made == [] and len(calls) == 1 and rows(again) == rows(first)
    assert "Join" not in again._jdf.queryExecution().toString()
    moved = sensors.withColumn("x_m", sensors.x_m + (sensors.obs_id == 6).cast("double"))
    written = {p.parent.parent.name: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("batch=*/print=*/*.parquet")}
    third, made = kernels.kept_kernel(moved, cells, make, path, "p", 4)
    assert made == [2] and calls[-1] == [2, 6, 10, 14, 18] and rows(third) == rows(S.gravity_kernel(moved, cells, 25.0, 80.0))
    later = {p.parent.parent.name: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("batch=*/print=*/*.parquet") if p.stat().st_mtime_ns not in written.values()}
    assert set(later) == {"batch=2"}
    some, made = kernels.kept_kernel(sensors.where("obs_id % 4 = 1"), cells, make, path, "p", 4)
    assert made == [] and {r.obs_id % 4 for r in some.collect()} == {1} and "PartitionFilters: [" in some._jdf.queryExecution().toString()
    _, made = kernels.kept_kernel(sensors, cells, make, path, "other", 4)
    assert made == [0, 1, 2, 3]
    _, made = kernels.kept_kernel(sensors, cells.where("voxel_id < 39"), make, path, "p", 4)
    assert made == [0, 1, 2, 3]


def test_kept_kernel_of_nothing(spark, tmp_path):
    """Sensors out of reach are batches without rows, no sensors none at all; both are known the next time."""
    far = spark.createDataFrame([(1, 1e6, 0.0, 0.0)], "obs_id long, x_m double, y_m double, z_m double")
    cells = spark.createDataFrame([(0, 12.5, 12.5, 12.5)], "voxel_id long, x double, y double, z double")
    make = lambda s, c: S.gravity_kernel(s, c, 25.0, 80.0)
    for expected in ([1], []):
        kernel, made = kernels.kept_kernel(far, cells, make, f"file://{tmp_path}/k", "p", 4)
        assert made == expected and kernel.count() == 0
    kernel, made = kernels.kept_kernel(far.where("obs_id < 0"), cells, make, f"file://{tmp_path}/k", "p", 4)
    assert made == [] and kernel.count() == 0


# --- bodies ---


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_joint_bodies_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    places = [p for p in itertools.product(range(9), range(7), range(6)) if rng.random() < 0.9]
    a, b = rng.random(len(places)), rng.random(len(places))
    xyz = np.array(places) * 10.0
    cells = spark.createDataFrame([(i, *map(float, xyz[i]), float(a[i]), float(b[i])) for i in range(len(places))], "voxel_id long, x double, y double, z double, a double, b double")
    got = {r.label: r for r in graph.joint_bodies(cells, "a", "b", 10.0, 1000.0, threshold=0.85).collect()}
    part = lambda v: np.clip((v - np.median(v)) / (v.max() - np.median(v)), 0, 1)
    mask = np.flatnonzero(np.sqrt(part(a) ** 2 + part(b) ** 2) > 0.85)
    root = {i: i for i in mask}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(mask, 2):
        if np.linalg.norm(xyz[i] - xyz[j]) <= 15:
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in mask:
        groups.setdefault(find(i), []).append(i)
    want = {k: v for k, v in groups.items() if len(v) >= 5}
    assert set(got) == set(want) and want
    order = sorted(want, key=lambda k: (-len(want[k]), k))
    for rank, k in enumerate(order):
        v = want[k]
        r = got[k]
        assert r.rank == rank and r.cells == len(v) and r.volume_m3 == 1000.0 * len(v)
        assert [r.x, r.y, r.z, r.a_mean, r.b_max] == pytest.approx([*xyz[v].mean(0), a[v].mean(), b[v].max()])
        assert r.correlation == pytest.approx(np.corrcoef(a[v], b[v])[0, 1])


def test_bodies_without_range_or_enough_cells(spark):
    flat = spark.createDataFrame([(i, 10.0 * i, 0.0, 0.0, 1.0, 2.0) for i in range(8)], "voxel_id long, x double, y double, z double, a double, b double")
    assert graph.joint_bodies(flat, "a", "b", 10.0, 1.0).collect() == []
    one = spark.createDataFrame([(i, 10.0 * i, 0.0, 0.0, 1.0, 9.0 if 3 <= i < 8 else 0.0) for i in range(20)], "voxel_id long, x double, y double, z double, a double, b double")
    body, = graph.joint_bodies(one, "a", "b", 10.0, 1.0).collect()
    assert (body.label, body.cells, body.correlation) == (3, 5, None)
    assert graph.joint_bodies(one, "a", "b", 10.0, 1.0, least=6).collect() == []
    assert graph.joint_bodies(one.where("voxel_id < 0"), "a", "b", 10.0, 1.0).collect() == []


# --- runs ---


def test_run_scores_gates_and_missing_factors(spark):
    table = lambda name, rows: spark.createDataFrame([(r, name, v) for r, v in rows], "run long, factor string, value double")
    factors = [table("anomaly_intensity", [(1, 0.8), (2, 3.0), (4, None)]), table("core_coherence", [(1, 0.4), (3, -1.0)]), table("satellite_support", [(1, None)])]
    runs = spark.createDataFrame([(1, "GOOD", 0.2), (2, "low", 0.4), (3, None, 0.9), (4, "MEDIUM", None), (5, "GOOD", None)], "run long, level string, uncertainty double")
    got = {r.run: r for r in audit.run_scores(factors, runs).collect()}
    assert got[1].evidence == pytest.approx((0.8 * 0.25 + 0.4 * 0.2) / 0.45) and got[1].score == pytest.approx(100 * got[1].evidence * 0.9) and got[1].level == "MODERADO"
    assert (got[2].raw, got[2].score, got[2].cap) == (pytest.approx(100 * 0.6 * 0.8), pytest.approx(48.0), 60.0)
    assert (got[3].evidence, got[3].score, got[3].level, got[3].cap) == (0.0, 0.0, "MUY BAJO", 40.0)
    assert got[4].weight == 0 and got[4].score == 0 and got[5].score == 0


def test_best_iterations_by_hand(spark):
    rows = [(1, 0, 0.2, 0.1, 0.1, 5.0, 50.0, 10), (1, 1, 0.9, 0.5, 0.5, -1.0, 10.0, 4), (1, 2, 0.4, 0.5, 0.6, 1.0, 20.0, 9), (2, 0, 0.5, 0.5, 0.5, 0.0, 1.0, 0), (2, 1, 0.5, 0.5, 0.5, 0.0, 60.0, 2), (3, 7, None, 0.1, 0.1, 0.1, 0.1, 1)]
    h = spark.createDataFrame(rows, "run long, it long, prauc double, topk double, iou double, y_err double, shallow double, n_active long")
    got = {r.run: r for r in audit.best_iterations(h, 30.0).collect()}
    assert (got[1].best_prauc, got[1].best_topk, got[1].best, got[1].reasons) == (1, 1, 1, "active|prauc")
    assert (got[2].best_prauc, got[2].best, got[2].reasons) == (0, 0, "shallow")  # 2 cells aren't over twice max(0, 1)
    assert not got[3].rebound and got[3].reasons == "none"


def test_padding_leak_of_nothing(spark):
    none = spark.createDataFrame([(True, None), (False, None)], "core boolean, contrast double")
    row = audit.padding_leak(none).first()
    assert (row.mass_total, row.ratio, row.status) == (0.0, 0.0, "PASS")
    row = audit.padding_leak(spark.createDataFrame([(True, -9.6), (False, 0.4)], "core boolean, contrast double")).first()
    assert row.ratio == pytest.approx(0.04) and row.status == "PASS"


# --- curves, headers, signals ---


def _curve(spark, points):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "i long, misfit double, norm double")


def test_corner_of_curves_without_curvature(spark):
    """A straight line, two points, points that coincide, and a triple that is too close: farthest from the line of the ends, else the middle."""
    from lodestone.operators import evaluation

    corner = lambda points: evaluation.lcurve_corner(_curve(spark, points), "i", "misfit", "norm").first()
    line = corner([(10.0**k, 10.0**-k) for k in range(5)])
    assert line.curvature is None or line.curvature < 1e-6
    two = corner([(1, 10), (10, 1)])
    assert (two.i, two.curvature) == (0, None)
    same = corner([(2, 3)] * 5)
    assert (same.i, same.curvature) == (2, None)
    close = corner([(1, 100), (1.00001, 50), (1000, 1)])  # bent, so by curvature
    assert close.i == 1 and close.curvature > 0
    tiny = corner([(1, 1000), (1.000001, 999.9999), (1000, 1)])  # the first side is below a thousandth
    assert tiny.curvature is None and tiny.i == 1


def test_header_goes_with_the_payload(spark):
    import io

    import pyarrow as pa

    from lodestone.sinks import export

    model = spark.createDataFrame([(i, 2.5 * i, 1.0, -3.0, 2.6 + i / 10) for i in range(8)], "voxel_id long, x double, y double, z double, density double")
    body, header = export.arrow_payload(model, ["voxel_id", "x"], 3, 2.5)
    assert pa.ipc.open_stream(io.BytesIO(body)).read_all().num_rows == 3
    assert header == {"total_voxels": "8", "bounds_min": "0.0000,1.0000,-3.0000", "bounds_max": "17.5000,1.0000,-3.0000", "cell_size": "2.5000", "domain_l": "17.5000", "domain_h": "0.0000", "domain_w": "0.0000", "density_min": "2.600000", "density_max": "3.300000"}


def test_report_signals(spark):
    from lodestone.operators import diagnostics

    of = lambda rows: diagnostics.report_signal(spark.createDataFrame(rows, "density double, probability double, grade double, mass double"), 2.75).first()
    a = of([(3.4, 0.8, 0.5, 2.0), (2.0, 0.2, None, 1.0), (None, 1.0, 9.0, 1.0)])
    assert (a.anomaly_score, a.max_probability, a.avg_grade, a.preliminary_signal, a.risk_level) == (pytest.approx(0.2), 0.8, pytest.approx(1 / 3), "DRILL_CANDIDATE", "LOW")
    b = of([(2.7, 0.5, 0.5, 1.0)])
    assert (b.preliminary_signal, b.risk_level) == ("OBSERVE", "HIGH")
    assert of([(3.0, 0.5, 0.5, None)]).risk_level == "MEDIUM"


def test_gaussian_bodies_and_noise(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import inversion

    cells = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 4.0, 0.0)], "voxel_id long, x double, y double, z double")
    c = {r.voxel_id: r.c for r in inversion.gaussian_body(cells, (F.lit(0.0), F.lit(0.0), F.lit(0.0)), 5.0, 0.8).collect()}
    assert c[0] == 0.8 and c[1] == pytest.approx(0.8 * np.exp(-0.5))
    d = {r.obs_id: r.d for r in inversion.noisy(spark.createDataFrame([(1, -4.0), (2, 1.0)], "obs_id long, d double"), spark.createDataFrame([(1, 0.5)], "obs_id long, error double"), 0.1).collect()}
    assert d == {1: pytest.approx(-3.8), 2: 1.0}
