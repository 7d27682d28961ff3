"""Work that must not grow with copies of stations, or with cells that nothing reaches."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import audit, graph, inversion, mine
from lodestone.operators import blocks as B
from lodestone.operators import spatial as S


def _met(spark, monkeypatch):
    """Pairs that each bucket join gives, as they are counted."""
    seen, join = [], S.bucket_join

    def counted(*args):
        out = join(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(S, "bucket_join", counted)
    return seen


def test_stations_at_one_place_meet_once(spark, monkeypatch):
    """Nearest stations and spacings, with 300 copies of each of 4 places: as many pairs as places give."""
    at = [(0.0, 0.0), (3.0, 4.0), (40.0, 0.0), (900.0, 900.0)]
    rows = spark.createDataFrame([(4 * c + i, *p) for c in range(300) for i, p in enumerate(at)] + [(5000, 903.0, 904.0)], "k long, x double, y double")
    asked = spark.createDataFrame([(1, 1.0, 0.0), (2, 30.0, 0.0), (3, 400.0, 0.0)], "v long, u double, w double")
    seen = _met(spark, monkeypatch)
    got = {r.v: (r.k, r.distance) for r in S.nearest(asked, rows, "v", "k", [("u", "x"), ("w", "y")], 8.0).collect()}
    assert got == {1: (0, 1.0), 2: (2, 10.0), 3: (2, 360.0)}
    spacing = {r.k: r.distance for r in S.nearest_other(rows, "k", ["x", "y"], 8.0).collect()}
    assert len(spacing) == 1201 and spacing.pop(5000) == 5.0 and set(spacing.values()) == {0.0}
    assert max(seen) <= 3 * 5


def test_components_never_broadcast_their_edges(spark):
    edges = spark.range(1, 2000).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    plan = graph.labelled(spark.range(2000).withColumnRenamed("id", "voxel_id").hint("merge"), edges)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_a_task_of_the_precedence_arcs_keeps_its_size(spark):
    """800,000 blocks, of which Spark's bytes tell little: no task makes more arcs than its share of the copies."""
    blocks = spark.range(800_000).selectExpr("id AS voxel_id", "id % 100 AS ix", "id DIV 100 % 80 AS iy", "id DIV 8000 AS iz")
    made = [r[1] for r in graph.precedence_arcs(blocks, 25.0, 25.0, 40.0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 79 * (100 * 100 + 4 * 99 * 100) and max(made) < 600_000


def test_blocks_that_no_profit_needs_reach_no_task(spark, monkeypatch):
    """Of 3 columns of 50 blocks only what lies above a profit is handed to the maximum flow; the pits are those of all blocks."""
    rows = [(1, 50 * c + i, 9.0 if (c, i) in ((0, 3), (1, 1)) else -1.0) for c in range(3) for i in range(50)]
    arcs = [(50 * c + i, 50 * c + i - 1) for c in range(3) for i in range(1, 50)]
    blocks = spark.createDataFrame(rows, "scenario int, voxel_id long, profit double")
    df = spark.createDataFrame(arcs, "src long, dst long")
    assert {r.voxel_id for r in mine.needed(blocks, df).collect()} == {0, 1, 2, 3, 50, 51}
    src, dst = (np.array(x) for x in zip(*arcs, strict=True))
    want = np.flatnonzero(mine.maximum_closure(np.array([r[2] for r in rows]), src, dst)).tolist()
    assert sorted(r.voxel_id for r in mine.pits(blocks, df).collect()) == want
    assert mine.pits(blocks.where("profit < 0"), df).count() == 0


def _line(spark, n=300, sensors=6):
    """A line of n cells, of which sensors see the first 12, at three places of two sensors each."""
    rng = np.random.default_rng(8)
    g = np.zeros((sensors, n))
    g[:, :12] = 2 * np.repeat(rng.normal(size=(sensors // 2, 12)), 2, 0)
    d = g @ rng.normal(size=n) + 0.1 * rng.normal(size=sensors)
    kernel = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(sensors) for j in range(12)], "obs_id long, voxel_id long, val double")
    data = spark.createDataFrame([(i, float(x), 0.5 + i / 10) for i, x in enumerate(d)], "obs_id long, d double, sigma double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    return g, d, 0.5 + np.arange(sensors) / 10, kernel, data, edges


def test_parts_of_a_grid_give_the_models_of_all_of_it(spark):
    """A part that begins too small grows until its model is that of the whole line; cells beyond have a row each."""
    n = 300
    g, d, sigma, kernel, data, edges = _line(spark, n)
    cells = spark.createDataFrame([(i, 1.0) for i in range(n)], "voxel_id long, w double")
    lap = sum((np.outer(v, v) for v in (np.eye(n)[i] - np.eye(n)[i + 1] for i in range(n - 1))), np.zeros((n, n)))
    gw = g / sigma[:, None]
    want = 0.2 + np.linalg.solve(gw.T @ gw + 0.25 * np.eye(n) + 0.49 * lap, gw.T @ (d / sigma - 0.2 * gw.sum(1)))
    got = [r.m for r in inversion.regularised(kernel, data, cells, edges, [(0, 0.5, 0.7, 0.2)], least=2).orderBy("voxel_id").collect()]
    assert len(got) == n and np.allclose(got, want, atol=1e-7) and got[-1] == 0.2
    part = B.Part(cells, edges, kernel.select("voxel_id").distinct(), True, 8)
    assert part.size == 20 and part.grown().size == 44 and not part.whole
    limits = cells.selectExpr("voxel_id", "w", "IF(voxel_id = 60, 0.3, -0.4D) AS lower", "IF(voxel_id = 60, 0.3, 0.5D) AS upper", "0D AS target")
    small, all_ = ([r.m for r in inversion.bounded(kernel, data, limits, edges, 0.5, 0.7, least=k).orderBy("voxel_id").collect()] for k in (4, 1000))
    assert np.allclose(small, all_, atol=1e-7) and small[60] == 0.3
    small, all_ = (inversion.krylov_cases(kernel, data, cells, edges, 0.7, [0.3, 2.0], least=k) for k in (4, 1000))
    of = lambda t: {(r.case_id, r.voxel_id): r.m for r in t.collect()}
    a, b = of(small[0]), of(all_[0])
    assert len(a) == 2 * n and all(abs(a[k] - b[k]) < 1e-6 for k in b)
    # sensors at one place stand for one with their weighted mean
    one = inversion.stacked(data.withColumn("place", F.expr("obs_id DIV 2 * 2")), "place")
    got = [r.m for r in inversion.regularised(kernel.where("obs_id % 2 = 0"), one, cells, edges, [(0, 0.5, 0.7, 0.2)]).orderBy("voxel_id").collect()]
    assert np.allclose(got, want, atol=1e-7)


def test_parts_of_many_groups_are_one_expression(spark, monkeypatch):
    """A filter on 3000 groups of cells: few calls of the JVM, and the cells of those groups."""
    cells = spark.range(8192).select(F.col("id").alias("voxel_id"), F.lit(1.0).alias("w"))
    part = B.Part(cells, cells.selectExpr("voxel_id AS src", "voxel_id + 1 AS dst"), cells.where("voxel_id < 6000").select("voxel_id"), False)
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **b: calls.append(1) or send(*a, **b))
    inside, outside = part.inside(cells, "voxel_id"), part.outside(cells)
    assert len(part.groups) == 3000 and len(calls) < 200
    assert inside.agg(F.count("*"), F.max("voxel_id")).first()[:] == (6000, 5999) and outside.count() == 2192


def test_rounds_of_two_physics_go_on_the_cells_near_their_kernels(spark, monkeypatch):
    """joint() beginning with few cells of a long column of voxels: models and history of the whole of it, on far fewer cells."""
    n, rng = 4 * 100, np.random.default_rng(5)
    at = [(i, i % 2, i // 2 % 2, i // 4) for i in range(n)]
    cells = spark.createDataFrame([(*a, 1.0) for a in at], "voxel_id long, ix long, iy long, iz long, w double")
    edges = S.face_edges(cells).select("src", "dst")
    physics = []
    for lower, upper in ((-0.6, 1.6), (0.0, None)):
        g = rng.normal(size=(6, 40))
        kernel = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(6) for j in range(40)], "obs_id long, voxel_id long, val double")
        data = spark.createDataFrame([(i, float(x), 0.3) for i, x in enumerate(g @ rng.random(40))], "obs_id long, d double, sigma double")
        physics.append((kernel, data, 3.0, 1.0, lower, upper))
    penalised, penalty = [], inversion.cross_penalty

    def counted(own, *args):
        penalised.append(own.count())
        return penalty(own, *args)

    monkeypatch.setattr(inversion, "cross_penalty", counted)
    (small, told), (all_, want) = (inversion.joint(cells, physics, edges, 25.0, 5.0, 1, least=k) for k in (60, 1 << 20))
    assert max(penalised[: len(penalised) // 2]) < n and penalised[-1] == n
    a, b = ({r.voxel_id: (r.a, r.b) for r in m.collect()} for m in (small, all_))
    assert len(a) == len(b) == n and all(np.allclose(a[k], b[k], atol=1e-7) for k in b) and a[n - 1] == (0.0, 0.0)
    one, other = ([tuple(r)[:6] for r in t.orderBy("round").collect()] for t in (told, want))
    assert len(one) == len(other) and all(np.allclose(*[[x or 0.0 for x in r] for r in p], rtol=1e-5) for p in zip(one, other, strict=True))


def test_strong_data_converge_by_the_matrix_of_rows():
    """Data 10^7 times the damping: conjugate gradients with the rows' matrix in few steps, also on some cells only."""
    rng = np.random.default_rng(3)
    n, rows = 80, 7
    g = 1e4 * rng.normal(size=(rows, n)) * rng.random((rows, n)) ** 8
    rest = 1e-3 * (0.1 + rng.random(n))
    block = (np.arange(rows) * n, np.tile(np.arange(n, dtype=np.int32), rows), g.ravel(), np.zeros(rows))
    operator = B.Arrays(n, [tuple(x.tobytes() for x in block)])
    matrix, rhs = g.T @ g + np.diag(rest), g.T @ rng.normal(size=rows)
    solve = operator.preconditioner(rest)
    x = B.conjugate_gradients(lambda p: matrix @ p, rhs[:, None], np.diag(matrix)[:, None].copy(), 12, 1e-8, lambda r, _: solve(r))
    assert np.linalg.norm(matrix @ x[:, 0] - rhs) <= 2e-8 * np.linalg.norm(rhs)
    free = np.arange(n) % 3 > 0
    part = operator.preconditioner(np.where(free, rest, np.inf))(np.where(free, rhs, 0.0))
    assert np.allclose(part[~free], 0) and np.allclose(part[free], np.linalg.solve(matrix[np.ix_(free, free)], rhs[free]), atol=1e-3 * np.abs(part).max())


def test_a_gaussian_body_is_recovered(spark):
    from lodestone.plans import all_queries as registry

    row = registry.QUERIES["gaussian_recovery"](spark, "/root/testdata/sf0.01").first()
    assert row.pearson > 0.9 and row.misfit_percent < 1


def test_evidence_does_not_depend_on_the_order_of_factors(spark):
    names = ["anomaly_intensity", "depth_accessibility", "core_coherence", "structural_gradient", "msx_support", "satellite_support"]
    values = [0.1, 0.7, 0.3, 0.9, 0.35, 0.6]
    rows = [spark.createDataFrame([(r, n, v) for r in range(50)], "run long, factor string, value double").repartition(k + 1) for k, (n, v) in enumerate(zip(names, values, strict=True))]
    runs = spark.createDataFrame([(r, "GOOD", 0.0) for r in range(50)], "run long, level string, uncertainty double")
    top, weight = 0.0, 0.0
    for n, v in zip(names, values, strict=True):
        top, weight = top + v * audit.WEIGHTS[n], weight + audit.WEIGHTS[n]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        assert {r.evidence for r in audit.run_scores(order, runs).collect()} == {top / weight}


def test_gates_do_not_depend_on_the_split_of_a_file(spark, tmp_path):
    """Lines of an order that lie in several tasks are summed as in one: a mean of 0.5 or a digit below it gives another gate."""
    import duckdb
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("orders", "lineitem"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.01/{t}.parquet"), tmp_path / f"{t}.parquet", row_group_size=3000)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    small = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out = entry.queries()["favorability_of_runs"](spark, f"file://{tmp_path}").select("run", "multiplier", "cap", "score", "level")
        got = {r.run: r[1:] for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {r[0]: r[1:] for r in con.execute(f"SELECT run, multiplier, cap, score, level FROM ({entry.oracle_sql()['favorability_of_runs']})").fetchall()}
    assert got.keys() == want.keys()
    assert [k for k in want if abs(got[k][0] - want[k][0]) > 1e-8 or got[k][1] != want[k][1] or abs(got[k][2] - want[k][2]) > 1e-8 or got[k][3] != want[k][3]] == []
