"""Queries on block models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import blockmodel as B
from lodestone.operators import profile as P
from lodestone.plans.registry import query
from lodestone.sources import adapters as A

# visual_score of v_voxels in SQL
_VIS = "vis AS (SELECT v.*, (density - lo) / greatest(hi - lo, CAST(1e-9 AS DOUBLE)) * least(greatest(probability, 0), 1) AS visual_score FROM v_voxels v, (SELECT min(density) AS lo, max(density) AS hi FROM v_voxels))"


def _voxels(spark, sf_dir):
    return B.with_visual_columns(A.voxels(spark, sf_dir))


_PCT = ", ".join(f"round(quantile_cont(v, CAST({q} AS DOUBLE)), 6) AS {n}" for n, q in B.PROFILE)


@query("block_percentiles", f"""
WITH {_VIS}, u AS (SELECT 'density' AS c, density AS v FROM vis UNION ALL SELECT 'probability', probability FROM vis UNION ALL SELECT 'rho', density FROM vis UNION ALL SELECT 'visual_score', visual_score FROM vis)
SELECT c AS "column", count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, {_PCT}, max(v) - min(v) <= CAST(1e-9 AS DOUBLE) AS is_degenerate FROM u GROUP BY c""")
def block_percentiles(spark, sf_dir):
    return B.percentile_profile(_voxels(spark, sf_dir), ["density", "probability", "rho", "visual_score"])


@query("block_thresholds", f"""
WITH {_VIS}, p AS (SELECT quantile_cont(density, CAST(0.02 AS DOUBLE)) AS d2, quantile_cont(density, CAST(0.98 AS DOUBLE)) AS d98, quantile_cont(visual_score, CAST(0.02 AS DOUBLE)) AS v2, quantile_cont(visual_score, CAST(0.85 AS DOUBLE)) AS v85, quantile_cont(visual_score, CAST(0.95 AS DOUBLE)) AS v95, quantile_cont(visual_score, CAST(0.98 AS DOUBLE)) AS v98 FROM vis),
r AS (SELECT *, CASE WHEN d2 IS NULL THEN 'computation_failed' WHEN abs(d98 - d2) < CAST(1e-6 AS DOUBLE) THEN 'uniform_density' WHEN abs(v98 - v2) < CAST(1e-6 AS DOUBLE) THEN 'uniform_visual_score' END AS reason FROM p)
SELECT reason, CASE WHEN reason IS NULL THEN round(v85, 6) END AS threshold, CASE WHEN reason IS NULL THEN round(v95, 6) END AS high, CASE WHEN reason IS NULL THEN round(v98, 6) END AS extreme FROM r""")
def block_thresholds(spark, sf_dir):
    p = _voxels(spark, sf_dir).agg(F.percentile("density", F.array(F.lit(0.02), F.lit(0.98))).alias("d"), F.percentile("visual_score", F.array(*map(F.lit, (0.02, 0.85, 0.95, 0.98)))).alias("v"))
    flat = lambda c, a, b: F.abs(F.col(c)[b] - F.col(c)[a]) < 1e-6
    reason = F.when(F.col("d")[0].isNull(), "computation_failed").when(flat("d", 0, 1), "uniform_density").when(flat("v", 0, 3), "uniform_visual_score")
    p = p.withColumn("reason", reason)
    cut = lambda i: F.when(F.col("reason").isNull(), F.round(F.col("v")[i], 6))
    return p.select("reason", cut(1).alias("threshold"), cut(2).alias("high"), cut(3).alias("extreme"))


@query("block_cell_size", "WITH d AS (SELECT DISTINCT x FROM v_voxels), g AS (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM d) SELECT coalesce(min(gap), CAST(10 AS DOUBLE)) AS cell_size FROM g WHERE gap > 0")
def block_cell_size(spark, sf_dir):
    return B.cell_size(A.voxels(spark, sf_dir), ["x", "y", "z"])


@query("block_grid_shape", "SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny, max(iz) + 1 AS nz, (max(ix) + 1) * (max(iy) + 1) * (max(iz) + 1) AS total, count(*) AS stored FROM v_voxels")
def block_grid_shape(spark, sf_dir):
    n = [(F.max(a) + 1) for a in ("ix", "iy", "iz")]
    return A.voxels(spark, sf_dir).agg(*[c.alias(f"n{a}") for c, a in zip(n, "xyz", strict=True)], (n[0] * n[1] * n[2]).alias("total"), F.count("*").alias("stored"))


for _by in ("density", "visual_score", "probability", "grade"):

    @query(f"block_topk_{_by.split('_')[0]}", f"WITH {_VIS} SELECT voxel_id, {_by} FROM vis ORDER BY {_by} DESC NULLS FIRST, voxel_id LIMIT 50")
    def block_topk(spark, sf_dir, by=_by):
        return B.top(_voxels(spark, sf_dir), by, 50, "voxel_id").select("voxel_id", by)


@query("block_selection_rank", f"WITH {_VIS} SELECT voxel_id, row_number() OVER (ORDER BY density DESC NULLS FIRST, voxel_id) - 1 AS rank FROM vis")
def block_selection_rank(spark, sf_dir):
    v = A.voxels(spark, sf_dir).withColumn("o", F.struct((-F.col("density")).alias("d"), "voxel_id"))
    return P.numbered(v, "o", "rank").select("voxel_id", "rank")


_LIMIT = 100
_EVEN = _LIMIT - 45 - 30 - 15


@query("block_exploration_view", f"""
WITH {_VIS}, n AS (SELECT count(*) AS n FROM vis),
r AS (SELECT *, row_number() OVER (ORDER BY visual_score DESC NULLS FIRST, voxel_id) AS rv, row_number() OVER (ORDER BY density DESC NULLS FIRST, voxel_id) AS rd, row_number() OVER (ORDER BY probability DESC NULLS FIRST, voxel_id) AS rp FROM vis),
e AS (SELECT voxel_id, rd AS rank FROM r, n WHERE (rd - 1) % greatest(n // {_EVEN}, 1) = 0 ORDER BY rd LIMIT {_EVEN}),
u AS (SELECT voxel_id, 0 AS b, rv AS rank FROM r WHERE rv <= 45 UNION ALL SELECT voxel_id, 1, rd FROM r WHERE rd <= 30 UNION ALL SELECT voxel_id, 2, rp FROM r WHERE rp <= 15 UNION ALL SELECT voxel_id, 3, rank FROM e UNION ALL SELECT voxel_id, 4, rv FROM r WHERE rv <= {2 * _LIMIT}),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY voxel_id ORDER BY b, rank) = 1),
g AS (SELECT voxel_id, row_number() OVER (ORDER BY b, rank) AS pick FROM f ORDER BY b, rank LIMIT {_LIMIT})
SELECT pick, voxel_id, density, probability, round(visual_score, 9) AS visual_score FROM g JOIN vis USING (voxel_id)""")
def block_exploration_view(spark, sf_dir):
    return B.exploration_view(_voxels(spark, sf_dir), _LIMIT).select("pick", "voxel_id", "density", "probability", F.round("visual_score", 9).alias("visual_score"))


@query("block_economic_view", "SELECT voxel_id, grade, domain FROM v_voxels WHERE grade > CAST(0.3 AS DOUBLE) ORDER BY grade DESC, voxel_id LIMIT 500")
def block_economic_view(spark, sf_dir):
    return B.top(A.voxels(spark, sf_dir).where("grade > 0.3"), "grade", 500, "voxel_id").select("voxel_id", "grade", "domain")


@query("block_anomaly", f"WITH {_VIS} SELECT voxel_id, density, round(visual_score, 9) AS visual_score FROM vis WHERE density >= CAST(2.75 AS DOUBLE) OR visual_score >= CAST(0.35 AS DOUBLE)")
def block_anomaly(spark, sf_dir):
    return _voxels(spark, sf_dir).where("density >= 2.75 OR visual_score >= 0.35").select("voxel_id", "density", F.round("visual_score", 9).alias("visual_score"))


@query("block_anomaly_fallback", "SELECT voxel_id, density FROM v_voxels WHERE density >= 100 UNION ALL SELECT voxel_id, density FROM v_voxels WHERE NOT EXISTS (SELECT 1 FROM v_voxels WHERE density >= 100) AND isfinite(density)")
def block_anomaly_fallback(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    some = v.agg(F.coalesce(F.max(F.col("density") >= 100), F.lit(False)).alias("some"))
    return v.join(F.broadcast(some)).where((F.col("density") >= 100) | (~F.col("some") & P.finite(F.col("density")))).select("voxel_id", "density")


@query("block_adaptive_cutoff", "SELECT round(least(greatest(avg(density) + CAST(0.5 AS DOUBLE) * stddev_pop(density), min(density) + CAST(0.01 AS DOUBLE)), max(density) - CAST(0.01 AS DOUBLE)), 6) AS cutoff FROM v_voxels")
def block_adaptive_cutoff(spark, sf_dir):
    return B.adaptive_cutoff(A.voxels(spark, sf_dir), 600.0).select(F.round("cutoff", 6).alias("cutoff"))


@query("block_visual_columns", f"WITH {_VIS} SELECT voxel_id, density, density AS rho, probability, round(visual_score, 9) AS visual_score, CAST(0 AS DOUBLE) AS tonnage, FALSE AS degraded FROM vis")
def block_visual_columns(spark, sf_dir):
    return _voxels(spark, sf_dir).select("voxel_id", "density", "rho", "probability", F.round("visual_score", 9).alias("visual_score"), "tonnage", "degraded")


@query("block_projection", """
SELECT voxel_id, round(density * pow(CAST(25 AS DOUBLE), 3), 6) AS mass_t, round((density - CAST(2.6 AS DOUBLE)) / CAST(1.6 AS DOUBLE), 9) AS density_score, round((density - CAST(2.6 AS DOUBLE)) / CAST(1.6 AS DOUBLE) * probability, 9) AS visual_score, CASE WHEN density >= CAST(2.75 AS DOUBLE) THEN 1 ELSE 0 END AS zone,
CASE WHEN probability >= CAST(0.75 AS DOUBLE) THEN 1 WHEN probability >= CAST(0.5 AS DOUBLE) THEN 2 WHEN probability >= CAST(0.25 AS DOUBLE) THEN 3 ELSE 0 END AS tier FROM v_voxels""")
def block_projection(spark, sf_dir):
    score, p = (F.col("density") - 2.6) / 1.6, F.col("probability")
    return A.voxels(spark, sf_dir).select("voxel_id", F.round(F.col("density") * 25.0**3, 6).alias("mass_t"), F.round(score, 9).alias("density_score"), F.round(score * p, 9).alias("visual_score"), F.when(F.col("density") >= 2.75, 1).otherwise(0).alias("zone"), F.when(p >= 0.75, 1).when(p >= 0.5, 2).when(p >= 0.25, 3).otherwise(0).alias("tier"))


@query("heuristic_grade", """
SELECT voxel_id, round(least(greatest((CAST(0.08 AS DOUBLE) + CAST(1.85 AS DOUBLE) * (density - CAST(2.6 AS DOUBLE)) / CAST(1.6 AS DOUBLE) + CAST(1.15 AS DOUBLE) * probability + CAST(0.45 AS DOUBLE) * ix / 20 + CAST(0.35 AS DOUBLE) * iy / 10) * CASE iz % 2 WHEN 0 THEN 1 ELSE CAST(1.1 AS DOUBLE) END * CASE WHEN probability < CAST(0.2 AS DOUBLE) THEN CAST(0.18 AS DOUBLE) ELSE 1 END, 0), 5), 6) AS grade FROM v_voxels""")
def heuristic_grade(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    g = B.heuristic_grade((F.col("density") - 2.6) / 1.6, F.col("probability"), F.col("ix") / 20, F.col("iy") / 10, F.when(F.col("iz") % 2 == 0, 1.0).otherwise(1.1), F.col("probability") < 0.2)
    return v.select("voxel_id", F.round(g, 6).alias("grade"))


@query("block_center_arrow", """
SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, CAST(x - (SELECT (min(x) + max(x)) / 2 FROM v_voxels) AS FLOAT) AS x, CAST(-y AS FLOAT) AS y, CAST(z - (SELECT (min(z) + max(z)) / 2 FROM v_voxels) AS FLOAT) AS z FROM v_voxels""")
def block_center_arrow(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    mid = v.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xz"])
    return v.join(F.broadcast(mid)).select(*[F.col(c).cast("int").alias(c) for c in ("ix", "iy", "iz")], (F.col("x") - F.col("mx")).cast("float").alias("x"), (-F.col("y")).cast("float").alias("y"), (F.col("z") - F.col("mz")).cast("float").alias("z"))


@query("dense_grid_fill", """
WITH k AS (SELECT * FROM v_voxels WHERE voxel_id % 3 <> 0), s AS (SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny, max(iz) + 1 AS nz FROM v_voxels), g AS (SELECT range AS voxel_id, range % nx AS ix, (range // nx) % ny AS iy, range // (nx * ny) AS iz FROM range(0, (SELECT nx * ny * nz FROM s)), s)
SELECT g.voxel_id, g.ix, g.iy, g.iz, coalesce(density, 0) AS density, coalesce(grade, 0) AS grade, coalesce(x, g.ix * 25 + CAST(12.5 AS DOUBLE)) AS x FROM g LEFT JOIN k USING (ix, iy, iz)""")
def dense_grid_fill(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    nx, ny, nz = (x + 1 for x in v.agg(F.max("ix"), F.max("iy"), F.max("iz")).first())
    kept = v.where("voxel_id % 3 <> 0").drop("voxel_id")
    return B.grid(spark, nx, ny, nz).join(kept, ["ix", "iy", "iz"], "left").select("voxel_id", "ix", "iy", "iz", F.coalesce("density", F.lit(0.0)).alias("density"), F.coalesce("grade", F.lit(0.0)).alias("grade"), F.coalesce("x", F.col("ix") * 25 + 12.5).alias("x"))


@query("fortran_order", "SELECT row_number() OVER (ORDER BY ix + 20 * iy + 200 * iz) - 1 AS place, ix, iy, iz, density FROM v_voxels")
def fortran_order(spark, sf_dir):
    v = A.voxels(spark, sf_dir).withColumn("o", F.col("ix") + 20 * F.col("iy") + 200 * F.col("iz"))
    return P.numbered(v, "o", "place").select("place", "ix", "iy", "iz", "density")


@query("ubc_rows", "SELECT row_number() OVER (ORDER BY ix, iy, iz DESC) - 1 AS line, printf('%.6f', density) AS value FROM v_voxels")
def ubc_rows(spark, sf_dir):
    """The lines of a .mod file: z fastest, from the deepest up."""
    v = A.voxels(spark, sf_dir).withColumn("o", F.struct("ix", "iy", (-F.col("iz")).alias("iz")))
    return P.numbered(v, "o", "line").select("line", F.format_string("%.6f", "density").alias("value"))


@query("gslib_rows", "SELECT voxel_id AS line, printf('%.3f %.3f %.3f %.6f', x, y, z, CASE WHEN probability < CAST(0.1 AS DOUBLE) THEN CAST(-9999 AS DOUBLE) ELSE density END) AS value FROM v_voxels")
def gslib_rows(spark, sf_dir):
    v = F.when(F.col("probability") < 0.1, -9999.0).otherwise(F.col("density"))
    return A.voxels(spark, sf_dir).select(F.col("voxel_id").alias("line"), F.format_string("%.3f %.3f %.3f %.6f", "x", "y", "z", v).alias("value"))


@query("quantile_variants", """
WITH r AS (SELECT iz, list_sort(list(density)) AS v, count(*) AS n, quantile_cont(density, CAST(0.8 AS DOUBLE)) AS linear FROM v_voxels GROUP BY iz)
SELECT iz, round(linear, 9) AS linear, v[CAST(round_even((n - 1) * CAST(0.8 AS DOUBLE), 0) AS BIGINT) + 1] AS nearest, v[CAST(floor((n - 1) * CAST(0.8 AS DOUBLE)) AS BIGINT) + 1] AS floored, v[least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1) + 1] AS floor_n FROM r""")
def quantile_variants(spark, sf_dir):
    return A.voxels(spark, sf_dir).groupBy("iz").agg(F.round(B.quantile("density", 0.8, "linear"), 9).alias("linear"), B.quantile("density", 0.8, "nearest").alias("nearest"), B.quantile("density", 0.8, "floor").alias("floored"), B.quantile("density", 0.95, "floor_n").alias("floor_n"))


@query("histogram", """
WITH e AS (SELECT min(density) AS lo, max(density) + CAST(1e-6 AS DOUBLE) AS hi FROM v_voxels) SELECT least(greatest(CAST(floor((density - lo) / ((hi - lo) / 24)) AS BIGINT), 0), 23) AS bin, count(*) AS n FROM v_voxels, e GROUP BY 1""")
def histogram(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    e = v.agg(F.min("density").alias("lo"), (F.max("density") + 1e-6).alias("hi"))
    at = F.floor((F.col("density") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 24))
    return v.join(F.broadcast(e)).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(23)).alias("bin")).agg(F.count("*").alias("n"))


@query("envelope_bbox", f"""
WITH {_VIS}, f AS (SELECT * FROM vis WHERE density >= CAST(2.7 AS DOUBLE) AND probability >= CAST(0.2 AS DOUBLE) AND visual_score >= CAST(0.05 AS DOUBLE)), r AS (SELECT *, row_number() OVER (ORDER BY visual_score DESC, voxel_id) AS k, count(*) OVER () AS n FROM f)
SELECT count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM r WHERE k <= greatest(1, CAST(round(n * CAST(0.25 AS DOUBLE)) AS BIGINT))""")
def envelope_bbox(spark, sf_dir):
    f = _voxels(spark, sf_dir).where("density >= 2.7 AND probability >= 0.2 AND visual_score >= 0.05")
    k = max(1, int(f.count() * 0.25 + 0.5))
    return B.top(f, "visual_score", k, "voxel_id").agg(F.count("*").alias("n"), *[g(c).alias(f"{c}_{n}") for c in "xyz" for g, n in ((F.min, "min"), (F.max, "max"))])


@query("highlight_voxel", "SELECT arg_max(voxel_id, ((density - CAST(2.6 AS DOUBLE)) * probability, -voxel_id)) AS voxel_id FROM v_voxels")
def highlight_voxel(spark, sf_dir):
    return A.voxels(spark, sf_dir).agg(F.max_by("voxel_id", F.struct((F.col("density") - 2.6) * F.col("probability"), -F.col("voxel_id"))).alias("voxel_id"))


@query("heatmap_top10", "SELECT voxel_id, round((density - CAST(2.6 AS DOUBLE)) * probability, 9) AS heat FROM v_voxels ORDER BY (density - CAST(2.6 AS DOUBLE)) * probability DESC, voxel_id LIMIT 10")
def heatmap_top10(spark, sf_dir):
    return A.voxels(spark, sf_dir).withColumn("heat", (F.col("density") - 2.6) * F.col("probability")).orderBy(F.desc("heat"), "voxel_id").limit(10).select("voxel_id", F.round("heat", 9).alias("heat"))


@query("voxel_visibility", f"WITH {_VIS} SELECT voxel_id FROM vis WHERE ix <= 15 AND probability >= CAST(0.05 AS DOUBLE) AND visual_score >= CAST(0.1 AS DOUBLE) AND density BETWEEN CAST(2.65 AS DOUBLE) AND CAST(4.1 AS DOUBLE)")
def voxel_visibility(spark, sf_dir):
    return _voxels(spark, sf_dir).where("ix <= 15 AND probability >= 0.05 AND visual_score >= 0.1 AND density BETWEEN 2.65 AND 4.1").select("voxel_id")


@query("magnetic_keep", "WITH s AS (SELECT *, density / 1000 AS k FROM v_voxels) SELECT voxel_id FROM s WHERE k >= greatest(CAST(1e-6 AS DOUBLE), CAST(0.9 AS DOUBLE) * (SELECT max(k) FROM s)) ORDER BY k DESC, voxel_id LIMIT 5000")
def magnetic_keep(spark, sf_dir):
    s = A.voxels(spark, sf_dir).withColumn("k", F.col("density") / 1000)
    most = s.agg(F.greatest(F.lit(1e-6), 0.9 * F.max("k")).alias("cut"))
    return s.join(F.broadcast(most)).where("k >= cut").orderBy(F.desc("k"), "voxel_id").limit(5000).select("voxel_id")


@query("joint_keep", """
WITH s AS (SELECT voxel_id, abs(density - CAST(2.6 AS DOUBLE)) AS d, probability / 100 AS k FROM v_voxels), m AS (SELECT max(d) AS md, max(k) AS mk FROM s)
SELECT voxel_id, round(CAST(0.5 AS DOUBLE) * d / md + CAST(0.5 AS DOUBLE) * k / mk, 9) AS score FROM s, m WHERE d >= greatest(CAST(0.02 AS DOUBLE), CAST(0.02 AS DOUBLE) * md) OR k >= greatest(CAST(1e-6 AS DOUBLE), CAST(0.01 AS DOUBLE) * mk) ORDER BY CAST(0.5 AS DOUBLE) * d / md + CAST(0.5 AS DOUBLE) * k / mk DESC, voxel_id LIMIT 8000""")
def joint_keep(spark, sf_dir):
    s = A.voxels(spark, sf_dir).select("voxel_id", F.abs(F.col("density") - 2.6).alias("d"), (F.col("probability") / 100).alias("k"))
    s = s.join(F.broadcast(s.agg(F.max("d").alias("md"), F.max("k").alias("mk"))))
    keep = (F.col("d") >= F.greatest(F.lit(0.02), 0.02 * F.col("md"))) | (F.col("k") >= F.greatest(F.lit(1e-6), 0.01 * F.col("mk")))
    score = 0.5 * F.col("d") / F.col("md") + 0.5 * F.col("k") / F.col("mk")
    return s.where(keep).withColumn("score", score).orderBy(F.desc("score"), "voxel_id").limit(8000).select("voxel_id", F.round("score", 9).alias("score"))


@query("active_cells", "SELECT voxel_id FROM v_voxels WHERE y - CAST(12.5 AS DOUBLE) >= (ix + iz) % 4 * 25")
def active_cells(spark, sf_dir):
    return A.voxels(spark, sf_dir).where((F.col("y") - 12.5) >= (F.col("ix") + F.col("iz")) % 4 * 25).select("voxel_id")


@query("union_by_name", "SELECT voxel_id, density, NULL::DOUBLE AS grade FROM v_voxels WHERE iz = 0 UNION ALL SELECT voxel_id, NULL, grade FROM v_voxels WHERE iz = 0")
def union_by_name(spark, sf_dir):
    v = A.voxels(spark, sf_dir).where("iz = 0")
    return v.select("voxel_id", "density").unionByName(v.select("voxel_id", "grade"), allowMissingColumns=True)


@query("padded_axis", """
WITH a AS (SELECT 'x' AS axis, max(ix) + 1 AS n FROM v_voxels UNION ALL SELECT 'y', max(iy) + 1 FROM v_voxels UNION ALL SELECT 'z', max(iz) + 1 FROM v_voxels),
c AS (SELECT axis, i, 25 * pow(CAST(1.3 AS DOUBLE), CASE WHEN i < 3 THEN 3 - i WHEN i >= n + 3 THEN i - n - 2 ELSE 0 END) AS width FROM (SELECT axis, n, unnest(range(0, n + 6)) AS i FROM a)), e AS (SELECT *, sum(width) OVER (PARTITION BY axis ORDER BY i) - width - 25 * (CAST(1.3 AS DOUBLE) + pow(CAST(1.3 AS DOUBLE), 2) + pow(CAST(1.3 AS DOUBLE), 3)) AS edge FROM c)
SELECT axis, i, round(width, 6) AS width, round(edge, 6) AS edge, round(edge + width / 2, 6) AS centre FROM e""")
def padded_axis(spark, sf_dir):
    """The three axes of the voxels' grid, with three growing cells at either end."""
    counts = A.voxels(spark, sf_dir).agg(*[(F.max(f"i{a}") + 1).alias(a) for a in "xyz"])
    axes = counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("n")) for a in "xyz"])).alias("a")).select("a.axis", "a.n")
    return B.padded_axes(axes, 25.0, 3).select("axis", "i", *[F.round(c, 6).alias(c) for c in ("width", "edge", "centre")])


@query("arrow_header", """
SELECT count(*) AS total_voxels, printf('%.4f,%.4f,%.4f', min(x), min(y), min(z)) AS bounds_min, printf('%.4f,%.4f,%.4f', max(x), max(y), max(z)) AS bounds_max, (SELECT printf('%.4f', min(gap)) FROM (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM (SELECT DISTINCT x FROM v_voxels)) WHERE gap > 0) AS cell_size, printf('%.4f', max(x) - min(x)) AS domain_l, printf('%.4f', max(y) - min(y)) AS domain_h, printf('%.4f', max(z) - min(z)) AS domain_w,
printf('%.6f', min(density)) AS density_min, printf('%.6f', max(density)) AS density_max FROM v_voxels""")
def arrow_header(spark, sf_dir):
    """What goes with the Arrow payload: bounds, cell size, extents and density range of the whole model."""
    v = A.voxels(spark, sf_dir)
    return B.header_stats(v, B.cell_size(v, ["x", "y", "z"]).first()[0])


_RANKINGS = {"density": "density", "probability": "probability", "grade": "grade"}


@query("rankings_top10", " UNION ALL ".join(f"(SELECT '{n}' AS ranking, row_number() OVER (ORDER BY {c} DESC, voxel_id) AS rank, voxel_id, {c} AS value FROM v_voxels ORDER BY {c} DESC, voxel_id LIMIT 10)" for n, c in _RANKINGS.items()).join(("SELECT * FROM (", ")")))
def rankings_top10(spark, sf_dir):
    """The first ten cells by density, by probability and by grade; ties to the smaller voxel_id. A top-k for each."""
    out = None
    for n, c in _RANKINGS.items():
        ten = A.voxels(spark, sf_dir).orderBy(F.desc(c), "voxel_id").limit(10).select(F.lit(n).alias("ranking"), "voxel_id", F.col(c).alias("value"))
        out = ten if out is None else out.unionByName(ten)
    rank = P.rank_over([F.desc("value"), F.col("voxel_id")], ["ranking"])
    return out.select("ranking", rank.cast("long").alias("rank"), "voxel_id", "value")  # thirty rows


@query("percentile_print", "SELECT unnest([0, 10, 25, 50, 75, 90, 100]) AS percent, unnest([round(q, 9) FOR q IN quantile_cont(density, [CAST(x AS DOUBLE) FOR x IN [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]])]) AS density, unnest([round(q, 9) FOR q IN quantile_cont(grade, [CAST(x AS DOUBLE) FOR x IN [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]])]) AS grade FROM v_voxels".replace("[CAST(x AS DOUBLE) FOR x IN [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]]", "[CAST(0 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.75 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(1 AS DOUBLE)]"))
def percentile_print(spark, sf_dir):
    """percent, density, grade at seven percentiles, both columns in one pass."""
    at = [0, 10, 25, 50, 75, 90, 100]
    v = A.voxels(spark, sf_dir).agg(*[F.percentile(c, F.array(*[F.lit(p / 100) for p in at])).alias(c) for c in ("density", "grade")])
    rows = v.select(F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("percent"), "density", "grade")).alias("r"))
    return rows.select("r.percent", F.round("r.density", 9).alias("density"), F.round("r.grade", 9).alias("grade"))
