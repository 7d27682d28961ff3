"""Queries with spatial joins, rasters, neighbours and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import spatial as S
from lodestone.plans.registry import query
from lodestone.sources import adapters as A

SIZE, CUTOFF, NEAR = 25.0, 120.0, 4 * 25.0 * (3 / (4 * 3.141592653589793)) ** (1 / 3)
_PAIRS = """pairs AS (SELECT s.obs_id, v.voxel_id, v.x - s.x_m AS dx, v.y - s.y_m AS dy, v.z - s.z_m AS dz, sqrt(pow(v.x - s.x_m, 2) + pow(v.y - s.y_m, 2) + pow(v.z - s.z_m, 2)) AS r
  FROM v_sensors s JOIN v_voxels v ON v.x BETWEEN s.x_m - 120 AND s.x_m + 120 AND v.y BETWEEN s.y_m - 120 AND s.y_m + 120 AND v.z BETWEEN s.z_m - 120 AND s.z_m + 120 WHERE pow(v.x - s.x_m, 2) + pow(v.y - s.y_m, 2) + pow(v.z - s.z_m, 2) <= 14400)"""
_corner = lambda i, j, k: f"({-i * j * k}) * (({{x}}) * ln(({{y}}) + {{r}} + CAST(1e-12 AS DOUBLE)) + ({{y}}) * ln(({{x}}) + {{r}} + CAST(1e-12 AS DOUBLE)) - ({{z}}) * atan2(({{x}}) * ({{y}}), ({{z}}) * {{r}} + CAST(1e-12 AS DOUBLE)))".format(x=f"dx + {i} * CAST(12.5 AS DOUBLE)", y=f"dz + {k} * CAST(12.5 AS DOUBLE)", z=f"dy + {j} * CAST(12.5 AS DOUBLE)", r=f"(sqrt(pow(dx + {i} * CAST(12.5 AS DOUBLE), 2) + pow(dz + {k} * CAST(12.5 AS DOUBLE), 2) + pow(dy + {j} * CAST(12.5 AS DOUBLE), 2)) + CAST(1e-12 AS DOUBLE))")
_PRISM = " + ".join(_corner(i, j, k) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1))
_KERNEL = f"""{_PAIRS}, kernel AS (SELECT obs_id, voxel_id, CAST(6.6743e-11 AS DOUBLE) * CASE WHEN r <= CAST({NEAR!r} AS DOUBLE) THEN {_PRISM} ELSE CAST(15625 AS DOUBLE) * dy / (r * r * r) END AS val FROM pairs)"""


def _kernel(spark, sf_dir):
    return S.gravity_kernel(A.sensors(spark, sf_dir), A.voxels(spark, sf_dir), SIZE, CUTOFF)


@query("distance_join", f"WITH {_PAIRS} SELECT obs_id, voxel_id, round(r, 6) AS r, r <= CAST({NEAR!r} AS DOUBLE) AS near FROM pairs")
def distance_join(spark, sf_dir):
    pairs = S.within_radius(A.sensors(spark, sf_dir), A.voxels(spark, sf_dir), [("x_m", "x"), ("y_m", "y"), ("z_m", "z")], CUTOFF)
    return pairs.select("obs_id", "voxel_id", F.round("r", 6).alias("r"), (F.col("r") <= NEAR).alias("near"))


@query("forward_gravity", f"WITH {_KERNEL} SELECT obs_id, round(sum(val * density) * CAST(1e9 AS DOUBLE), 4) AS d_nano FROM kernel JOIN v_voxels USING (voxel_id) GROUP BY obs_id")
def forward_gravity(spark, sf_dir):
    return S.forward(_kernel(spark, sf_dir), A.voxels(spark, sf_dir), "density").select("obs_id", F.round(F.col("d") * 1e9, 4).alias("d_nano"))


@query("forward_magnetic", f"""
WITH {_PAIRS}, f AS (SELECT *, dx * cos(radians(CAST(-30 AS DOUBLE))) * cos(radians(CAST(2 AS DOUBLE))) + dy * sin(radians(CAST(-30 AS DOUBLE))) + dz * cos(radians(CAST(-30 AS DOUBLE))) * sin(radians(CAST(2 AS DOUBLE))) AS dot FROM pairs)
SELECT obs_id, round(sum(CAST(25000 AS DOUBLE) * 15625 / (4 * pi()) * (3 * dot * dot / (r * r) - 1) / (r * r * r) * density / 1000), 5) AS tmi FROM f JOIN v_voxels USING (voxel_id) GROUP BY obs_id""")
def forward_magnetic(spark, sf_dir):
    k = S.magnetic_kernel(A.sensors(spark, sf_dir), A.voxels(spark, sf_dir), SIZE, CUTOFF, 25000.0, -30.0, 2.0)
    return S.forward(k, A.voxels(spark, sf_dir).withColumn("chi", F.col("density") / 1000), "chi").select("obs_id", F.round("d", 5).alias("tmi"))


@query("kernel_column_norms", f"WITH {_KERNEL}, n AS (SELECT voxel_id, sqrt(sum(val * val)) AS norm FROM kernel GROUP BY voxel_id) SELECT voxel_id, round(norm / (SELECT max(norm) FROM n), 6) AS sensitivity FROM n")
def kernel_column_norms(spark, sf_dir):
    n = _kernel(spark, sf_dir).groupBy("voxel_id").agg(F.sqrt(F.sum(F.col("val") ** 2)).alias("norm"))
    return n.join(F.broadcast(n.agg(F.max("norm").alias("most")))).select("voxel_id", F.round(F.col("norm") / F.col("most"), 6).alias("sensitivity"))


@query("observable_domain", f"WITH {_KERNEL}, n AS (SELECT voxel_id, sum(val * val) AS s FROM kernel GROUP BY voxel_id), k AS (SELECT voxel_id FROM n WHERE s > CAST(1e-6 AS DOUBLE) * (SELECT max(s) FROM n)) SELECT voxel_id, density FROM v_voxels SEMI JOIN k USING (voxel_id)")
def observable_domain(spark, sf_dir):
    at = S.places(A.sensors(spark, sf_dir), "obs_id", ["x_m", "y_m", "z_m"])  # the sensors at a place have equal rows
    k = S.gravity_kernel(at, A.voxels(spark, sf_dir), SIZE, CUTOFF).hint("merge").join(at.select("obs_id", "n"), "obs_id")
    n = k.groupBy("voxel_id").agg(F.sum(F.col("n") * F.col("val") ** 2).alias("s"))
    kept = n.join(F.broadcast(n.agg(F.max("s").alias("most")))).where("s > 1e-6 * most").select("voxel_id")
    return A.voxels(spark, sf_dir).join(kept, "voxel_id", "left_semi").select("voxel_id", "density")


@query("borehole_anchors", """
WITH m AS (SELECT hole, voxel_id, y, b.density, y BETWEEN y_from_m AND y_to_m AS inside, abs(y - (y_from_m + y_to_m) / 2) AS away FROM v_boreholes b JOIN v_voxels v ON floor(v.x / 25) = floor(b.x_m / 25) AND floor(v.z / 25) = floor(b.z_m / 25)),
r AS (SELECT *, max(inside) OVER (PARTITION BY hole) AS has, row_number() OVER (PARTITION BY hole ORDER BY away, voxel_id) AS k FROM m)
SELECT voxel_id, max(hole) AS hole, arg_max(density, hole) AS density FROM r WHERE inside OR (NOT has AND k = 1) GROUP BY voxel_id""")
def borehole_anchors(spark, sf_dir):
    return S.interval_anchors(A.voxels(spark, sf_dir), A.boreholes(spark, sf_dir), SIZE)


@query("nearest_sensor", """
WITH d AS (SELECT voxel_id, obs_id, sqrt(pow(v.x - s.x_m, 2) + pow(v.z - s.z_m, 2)) AS r FROM v_voxels v, v_sensors s WHERE v.iy = 0)
SELECT voxel_id, arg_min(obs_id, (r, obs_id)) AS obs_id, round(min(r), 6) AS distance FROM d GROUP BY voxel_id""")
def nearest_sensor(spark, sf_dir):
    v = A.voxels(spark, sf_dir).where("iy = 0").select("voxel_id", "x", "z")
    return S.nearest(v, A.sensors(spark, sf_dir).select("obs_id", "x_m", "z_m"), "voxel_id", "obs_id", [("x", "x_m"), ("z", "z_m")], 50.0).select("voxel_id", "obs_id", F.round("distance", 6).alias("distance"))


@query("spacing_p10", """
WITH n AS (SELECT a.obs_id, min(sqrt(pow(a.x_m - b.x_m, 2) + pow(a.z_m - b.z_m, 2))) AS d FROM v_sensors a JOIN v_sensors b ON a.obs_id <> b.obs_id GROUP BY a.obs_id)
SELECT count(*) AS n, round(quantile_cont(d, CAST(0.1 AS DOUBLE)), 6) AS p10, round(greatest(quantile_cont(d, CAST(0.1 AS DOUBLE)), 500), 6) AS step FROM n""")
def spacing_p10(spark, sf_dir):
    d = S.nearest_other(A.sensors(spark, sf_dir), "obs_id", ["x_m", "z_m"], cell=20.0)
    return d.agg(F.count("*").alias("n"), F.round(F.percentile("distance", 0.1), 6).alias("p10"), F.round(F.greatest(F.percentile("distance", 0.1), F.lit(500.0)), 6).alias("step"))


@query("close_pairs", "SELECT count(*) > 0 AS some FROM v_sensors a JOIN v_sensors b ON b.obs_id < a.obs_id AND abs(a.x_m - b.x_m) <= CAST(0.1 AS DOUBLE) AND abs(a.z_m - b.z_m) <= CAST(0.1 AS DOUBLE) WHERE pow(a.x_m - b.x_m, 2) + pow(a.z_m - b.z_m, 2) <= CAST(0.01 AS DOUBLE)")
def close_pairs(spark, sf_dir):
    s = A.sensors(spark, sf_dir)
    pairs = S.within_radius(s.select("obs_id", "x_m", "z_m"), s.select(F.col("obs_id").alias("o"), F.col("x_m").alias("u"), F.col("z_m").alias("w")), [("x_m", "u"), ("z_m", "w")], 0.1)
    return pairs.where("o < obs_id").limit(1).agg((F.count("*") > 0).alias("some"))


@query("dem_bilinear", """
WITH p AS (SELECT obs_id, least(greatest(x_m / CAST(5003 AS DOUBLE) * 31, 0), 31) AS u, least(greatest(z_m / CAST(4999 AS DOUBLE) * 31, 0), 31) AS v FROM v_obs), q AS (SELECT *, least(floor(u), 30) AS c, least(floor(v), 30) AS r FROM p)
SELECT obs_id, round(a.elev * (1 - (u - c)) * (1 - (v - r)) + b.elev * (u - c) * (1 - (v - r)) + d.elev * (1 - (u - c)) * (v - r) + e.elev * (u - c) * (v - r), 6) AS elevation
FROM q JOIN v_dem a ON a.row = r AND a.col = c JOIN v_dem b ON b.row = r AND b.col = c + 1 JOIN v_dem d ON d.row = r + 1 AND d.col = c JOIN v_dem e ON e.row = r + 1 AND e.col = c + 1""")
def dem_bilinear(spark, sf_dir):
    out = S.sample_dem(A.observations(spark, sf_dir), A.dem(spark, sf_dir), F.col("x_m") / 5003.0 * 31, F.col("z_m") / 4999.0 * 31, 32)
    return out.select("obs_id", F.round("elevation", 6).alias("elevation"))


@query("voxel_elevation", """
SELECT voxel_id, elev AS surface_m, y AS depth_m, elev - y AS elevation_m FROM v_voxels JOIN v_dem ON row = iy * 3 AND col = ix""")
def voxel_elevation(spark, sf_dir):
    v = A.voxels(spark, sf_dir).withColumns({"row": F.col("iy") * 3, "col": F.col("ix")})
    return v.join(A.dem(spark, sf_dir), ["row", "col"]).select("voxel_id", F.col("elev").alias("surface_m"), F.col("y").alias("depth_m"), (F.col("elev") - F.col("y")).alias("elevation_m"))


@query("dem_stats", "SELECT min(elev) AS lo, max(elev) AS hi, round(avg(elev), 6) AS mean, count(*) AS n FROM v_dem")
def dem_stats(spark, sf_dir):
    return A.dem(spark, sf_dir).agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"), F.round(F.avg("elev"), 6).alias("mean"), F.count("*").alias("n"))


@query("median_filter", """
WITH o AS (SELECT range - 1 AS d FROM range(0, 3)) SELECT a.row, a.col, median(b.elev) AS elev FROM v_dem a, o r, o c, v_dem b WHERE b.row = least(greatest(a.row + r.d, 0), 31) AND b.col = least(greatest(a.col + c.d, 0), 31) GROUP BY a.row, a.col""")
def median_filter(spark, sf_dir):
    return S.median_filter(A.dem(spark, sf_dir), "elev")


@query("spectral_indices", """
SELECT row, col, round((b8 - b4) / greatest(b8 + b4, 1), 6) AS ndvi, round(b4 / greatest(b2, 1), 6) AS iron, round(b11 / greatest(b12, 1), 6) AS clay FROM
(SELECT row, col, elev AS b8, elev / 2 AS b4, elev / 4 AS b2, elev + row AS b11, elev - col AS b12, (row + col) % 8 AS scl FROM v_dem) WHERE scl IN (4, 5, 7)""")
def spectral_indices(spark, sf_dir):
    e = F.col("elev")
    p = A.dem(spark, sf_dir).select("row", "col", e.alias("b8"), (e / 2).alias("b4"), (e / 4).alias("b2"), (e + F.col("row")).alias("b11"), (e - F.col("col")).alias("b12"), ((F.col("row") + F.col("col")) % 8).alias("scl"))
    ratio = lambda a, b: F.round(a / F.greatest(b, F.lit(1.0)), 6)
    return p.where(F.col("scl").isin(4, 5, 7)).select("row", "col", ratio(F.col("b8") - F.col("b4"), F.col("b8") + F.col("b4")).alias("ndvi"), ratio(F.col("b4"), F.col("b2")).alias("iron"), ratio(F.col("b11"), F.col("b12")).alias("clay"))


@query("spectral_stats", "SELECT count(*) AS n, round(avg(elev), 6) AS mean, round(quantile_cont(elev, CAST(0.9 AS DOUBLE)), 6) AS p90, round(stddev_pop(elev), 6) AS std, round(avg(CASE WHEN (row + col) % 8 IN (4, 5, 7) THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS valid_ratio FROM v_dem")
def spectral_stats(spark, sf_dir):
    ok = ((F.col("row") + F.col("col")) % 8).isin(4, 5, 7)
    return A.dem(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("elev"), 6).alias("mean"), F.round(F.percentile("elev", 0.9), 6).alias("p90"), F.round(F.stddev_pop("elev"), 6).alias("std"), F.round(F.avg(ok.cast("double")), 6).alias("valid_ratio"))


@query("laplacian_edges", """
SELECT a.voxel_id AS src, b.voxel_id AS dst, CASE WHEN b.ix > a.ix THEN 'ix' WHEN b.iy > a.iy THEN 'iy' ELSE 'iz' END AS axis FROM v_voxels a JOIN v_voxels b
ON (b.ix = a.ix + 1 AND b.iy = a.iy AND b.iz = a.iz) OR (b.ix = a.ix AND b.iy = a.iy + 1 AND b.iz = a.iz) OR (b.ix = a.ix AND b.iy = a.iy AND b.iz = a.iz + 1)""")
def laplacian_edges(spark, sf_dir):
    return S.face_edges(A.voxels(spark, sf_dir))


@query("laplacian_apply", """
WITH e AS (SELECT a.voxel_id AS i, b.density - a.density AS d FROM v_voxels a JOIN v_voxels b ON abs(b.ix - a.ix) + abs(b.iy - a.iy) + abs(b.iz - a.iz) = 1)
SELECT i AS voxel_id, round(sum(d) / 625, 9) AS laplacian FROM e GROUP BY i""")
def laplacian_apply(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    e = S.face_edges(v)
    both = e.select(F.col("src").alias("i"), F.col("dst").alias("j")).unionByName(e.select(F.col("dst").alias("i"), F.col("src").alias("j")))
    val = v.select("voxel_id", "density")
    j = both.join(val.withColumnsRenamed({"voxel_id": "i", "density": "a"}), "i").join(val.withColumnsRenamed({"voxel_id": "j", "density": "b"}), "j")
    return j.groupBy(F.col("i").alias("voxel_id")).agg(F.round(F.sum(F.col("b") - F.col("a")) / 625, 9).alias("laplacian"))


_D = lambda axis, other: f"CASE WHEN lag(density) OVER {axis} IS NULL THEN (lead(density) OVER {axis} - density) / 25 WHEN lead(density) OVER {axis} IS NULL THEN (density - lag(density) OVER {axis}) / 25 ELSE (lead(density) OVER {axis} - lag(density) OVER {axis}) / 50 END"


@query("gradient_stencil", f"SELECT voxel_id, round({_D('wx', 0)}, 9) AS gx, round({_D('wy', 0)}, 9) AS gy, round({_D('wz', 0)}, 9) AS gz FROM v_voxels WINDOW wx AS (PARTITION BY iy, iz ORDER BY ix), wy AS (PARTITION BY ix, iz ORDER BY iy), wz AS (PARTITION BY ix, iy ORDER BY iz)")
def gradient_stencil(spark, sf_dir):
    return S.gradient(A.voxels(spark, sf_dir), "density", 25.0).select("voxel_id", *[F.round(c, 9).alias(c) for c in ("gx", "gy", "gz")])


def _octree_sql() -> str:
    """c3: the leaves after three rounds, each a step of plain SQL."""
    steps = ["s AS (SELECT DISTINCT x_m, y_m, z_m FROM v_sensors), c0 AS (SELECT CAST(0 AS BIGINT) AS cell_id, 0 AS level, " + ", ".join(f"CAST({512 * e} AS DOUBLE) AS {a}{e}" for a in "xyz" for e in (0, 1)) + ")"]
    for k in range(3):
        widest = "greatest(x1 - x0, y1 - y0, z1 - z0)"
        steps.append(f"h{k} AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE " + " + ".join(f"pow(({a}0 + {a}1) / 2 - {a}_m, 2)" for a in "xyz") + f" <= pow({widest} * CAST(0.75 AS DOUBLE), 2)) AS hit FROM c{k})")
        side = ", ".join(f"CASE WHEN hit AND (range >> {b}) & 1 = 1 THEN ({a}0 + {a}1) / 2 ELSE {a}0 END AS {a}0, CASE WHEN hit AND (range >> {b}) & 1 = 0 THEN ({a}0 + {a}1) / 2 ELSE {a}1 END AS {a}1" for b, a in enumerate("xyz"))
        steps.append(f"c{k + 1} AS (SELECT CASE WHEN hit THEN cell_id * 8 + range + 1 ELSE cell_id END AS cell_id, CASE WHEN hit THEN level + 1 ELSE level END AS level, {side} FROM h{k}, range(8) WHERE hit OR range = 0)")
    return ",\n".join(steps)


@query("octree_split", f"WITH {_octree_sql()} SELECT * FROM c3")
def octree_split(spark, sf_dir):
    """Three rounds from one cell."""
    return octree(spark, sf_dir)


def octree(spark, sf_dir):
    edge = 512.0
    cells = spark.range(1).select(F.lit(0).cast("long").alias("cell_id"), F.lit(0).alias("level"), *[F.lit(edge * int(e)).alias(f"{a}{e}") for a in "xyz" for e in "01"])
    s = A.sensors(spark, sf_dir).select("x_m", "y_m", "z_m").distinct()
    for _ in range(3):
        cells = S.octree_level(cells, s, 0.75)
    return cells


_FACES = " UNION ALL ".join(f"SELECT a.cell_id AS src, b.cell_id AS dst, '{a}' AS axis, 2 / (a.{a}1 - a.{a}0 + b.{a}1 - b.{a}0) AS weight FROM c3 a JOIN c3 b ON a.{a}1 = b.{a}0 AND " + " AND ".join(f"a.{o}0 < b.{o}1 AND b.{o}0 < a.{o}1" for o in "xyz" if o != a) for a in "xyz")


@query("octree_edges", f"WITH {_octree_sql()} {_FACES}")
def octree_edges(spark, sf_dir):
    """Leaves that share part of a face."""
    return S.octree_edges(octree(spark, sf_dir))


@query("mask_jaccard", """
WITH a AS (SELECT voxel_id FROM v_voxels WHERE density >= CAST(3.5 AS DOUBLE)), b AS (SELECT voxel_id FROM v_voxels WHERE probability >= CAST(0.5 AS DOUBLE))
SELECT count(*) AS n_union, count(*) FILTER (a.voxel_id IS NOT NULL AND b.voxel_id IS NOT NULL) AS n_both, round(CAST(count(*) FILTER (a.voxel_id IS NOT NULL AND b.voxel_id IS NOT NULL) AS DOUBLE) / greatest(count(*), 1), 6) AS jaccard FROM a FULL JOIN b ON a.voxel_id = b.voxel_id""")
def mask_jaccard(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    a, b = v.where("density >= 3.5").select("voxel_id", F.lit(1).alias("a")), v.where("probability >= 0.5").select("voxel_id", F.lit(1).alias("b"))
    both = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    return a.join(b, "voxel_id", "full").agg(F.count("*").alias("n_union"), both.alias("n_both"), F.round(both.cast("double") / F.greatest(F.count("*"), F.lit(1)), 6).alias("jaccard"))


