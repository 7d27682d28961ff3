"""Queries on fit, uncertainty, favourability and run comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import diagnostics as D
from lodestone.operators import graph as G
from lodestone.operators import spatial as S
from lodestone.plans.registry import QUERIES, SQL, query
from lodestone.sources import adapters as A

# observed and predicted values of orders stand for those of sensors
_FIT = "f AS (SELECT o_orderkey AS obs_id, o_totalprice AS d, o_totalprice * (CAST(0.9 AS DOUBLE) + CAST(o_orderkey % 21 AS DOUBLE) / 100) AS p FROM orders)"


def _fitted(spark, sf_dir):
    k = F.col("o_orderkey")
    return A.table(spark, sf_dir, "orders").select(k.alias("obs_id"), F.col("o_totalprice").alias("d"), (F.col("o_totalprice") * (0.9 + (k % 21).cast("double") / 100)).alias("p"))


@query("fit_residuals", f"""
WITH {_FIT}, r AS (SELECT d - p AS r, greatest(CAST(0.02 AS DOUBLE) * abs(d), CAST(0.01 AS DOUBLE) * (max(d) OVER () - min(d) OVER ())) AS s FROM f)
SELECT count(*) AS n, round(sqrt(avg(r * r)), 4) AS rmse, round(avg(abs(r)), 4) AS mae, round(sqrt(sum(r * r)), 2) AS l2, round(avg(r), 4) AS bias, round(stddev_pop(r), 4) AS std, round(avg(pow(r / s, 2)), 6) AS chi2 FROM r""")
def fit_residuals(spark, sf_dir):
    f = D.fit(_fitted(spark, sf_dir), "d", "p")
    return f.select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("l2", 2).alias("l2"), F.round("bias", 4).alias("bias"), F.round("std", 4).alias("std"), F.round("chi2", 6).alias("chi2"))


# a survey on a domain of 6 by 25 km, and what a model predicts for it
_SURVEY = """f AS (SELECT obs_id, g AS d, g * (CAST(0.9 AS DOUBLE) + CAST(obs_id % 21 AS DOUBLE) / 100) AS p FROM v_obs), e AS (SELECT greatest(max(abs(d - p)), CAST(1e-12 AS DOUBLE)) AS most FROM f),
m AS (SELECT obs_id, d - p AS residual, abs(d - p) / most AS normalized FROM f, e), rm AS (SELECT *, CASE WHEN normalized < CAST(0.33 AS DOUBLE) THEN 'LOW' WHEN normalized < CAST(0.66 AS DOUBLE) THEN 'MEDIUM' ELSE 'HIGH' END AS residual_level FROM m)"""
_QAQC = """q AS (SELECT count(*) AS n, (max(x_m) - min(x_m)) / 6000 AS coverage_x, (max(z_m) - min(z_m)) / 25000 AS coverage_z, max(g) - min(g) AS dynamic_range, avg(g) AS mean, stddev_pop(g) AS std, sqrt(avg(g * g)) AS rms FROM v_obs),
w AS (SELECT *, list_filter([CASE WHEN coverage_x < CAST(0.35 AS DOUBLE) THEN 'low_coverage_x' END, CASE WHEN coverage_z < CAST(0.35 AS DOUBLE) THEN 'low_coverage_z' END, CASE WHEN dynamic_range <= CAST(1e-6 AS DOUBLE) THEN 'low_dynamic_range' END, CASE WHEN n < 20 THEN 'few_observations' END, CASE WHEN coverage_x < CAST(0.2 AS DOUBLE) AND coverage_z < CAST(0.2 AS DOUBLE) THEN 'concentrated' END], lambda x: x IS NOT NULL) AS warnings FROM q),
s AS (SELECT *, CASE WHEN len(warnings) = 0 THEN 'GOOD' WHEN len(warnings) <= 2 THEN 'MEDIUM' ELSE 'LOW' END AS survey_level FROM w)"""
_SUMMARY = f"""{_SURVEY}, {_QAQC}, fl AS (SELECT sqrt(avg(pow(d - p, 2))) / greatest(max(abs(d)), CAST(1e-12 AS DOUBLE)) AS normalized_rmse FROM f), r AS (SELECT avg(CASE WHEN residual_level = 'HIGH' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS high_ratio, count(*) AS n_residuals FROM rm),
l AS (SELECT *, CASE WHEN normalized_rmse < CAST(0.05 AS DOUBLE) THEN 'GOOD' WHEN normalized_rmse < CAST(0.2 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS fit_level, CASE WHEN high_ratio <= CAST(0.1 AS DOUBLE) THEN 'GOOD' WHEN high_ratio <= CAST(0.25 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS residual_level FROM s, fl, r),
t AS (SELECT *, CASE WHEN survey_level = 'GOOD' AND fit_level = 'GOOD' AND residual_level = 'GOOD' THEN 'GOOD' WHEN survey_level = 'LOW' OR fit_level = 'LOW' OR (residual_level = 'LOW' AND n_residuals >= 10) THEN 'LOW' ELSE 'MEDIUM' END AS overall_level FROM l)"""


def _survey(spark, sf_dir):
    k = F.col("obs_id")
    return A.observations(spark, sf_dir).select("obs_id", F.col("g").alias("d"), (F.col("g") * (0.9 + (k % 21).cast("double") / 100)).alias("p"))


def _summary(spark, sf_dir):
    f = _survey(spark, sf_dir)
    return D.technical_summary(D.qaqc(A.observations(spark, sf_dir), 6000.0, 25000.0), D.fit_level(f, "d", "p"), D.residual_map(f, "d", "p"))


@query("residual_levels", f"WITH {_SURVEY} SELECT residual_level AS level, count(*) AS n FROM rm GROUP BY residual_level")
def residual_levels(spark, sf_dir):
    return D.residual_map(_survey(spark, sf_dir), "d", "p").groupBy(F.col("residual_level").alias("level")).agg(F.count("*").alias("n"))


@query("sensor_flags", f"""
WITH {_SURVEY} SELECT obs_id, round(residual, 6) AS residual, round(normalized, 6) AS normalized, concat_ws(',', CASE WHEN residual_level = 'HIGH' THEN 'HIGH_RESIDUAL' END, CASE WHEN normalized >= CAST(0.85 AS DOUBLE) THEN 'EXTREME_NORMALIZED_RESIDUAL' END) AS flags, CASE WHEN normalized >= CAST(0.85 AS DOUBLE) THEN 'HIGH' ELSE 'MEDIUM' END AS review_priority
FROM rm WHERE residual_level = 'HIGH' OR normalized >= CAST(0.85 AS DOUBLE) ORDER BY abs(rm.residual) DESC, obs_id LIMIT 50""")
def sensor_flags(spark, sf_dir):
    """The fifty flagged sensors with the largest residuals."""
    top = D.sensor_flags(D.residual_map(_survey(spark, sf_dir), "d", "p")).orderBy(F.desc(F.abs("residual")), "obs_id").limit(50)
    return top.select("obs_id", F.round("residual", 6).alias("residual"), F.round("normalized", 6).alias("normalized"), F.array_join("flags", ",").alias("flags"), "review_priority")


@query("sensor_flag_level", f"""
WITH {_SURVEY}, c AS (SELECT count(*) AS sensor_count, count(*) FILTER (residual_level = 'HIGH' OR normalized >= CAST(0.85 AS DOUBLE)) AS flagged_count FROM rm), x AS (SELECT *, CAST(flagged_count AS DOUBLE) / greatest(sensor_count, 1) AS ratio FROM c)
SELECT sensor_count, flagged_count, round(ratio, 4) AS flagged_ratio, CASE WHEN ratio <= CAST(0.1 AS DOUBLE) THEN 'LOW' WHEN ratio <= CAST(0.25 AS DOUBLE) THEN 'MEDIUM' ELSE 'HIGH' END AS flag_level FROM x""")
def sensor_flag_level(spark, sf_dir):
    bad = (F.col("residual_level") == "HIGH") | (F.col("normalized") >= 0.85)
    c = D.residual_map(_survey(spark, sf_dir), "d", "p").agg(F.count("*").alias("sensor_count"), F.count(F.when(bad, 1)).alias("flagged_count"))
    ratio = F.col("flagged_count") / F.greatest(F.col("sensor_count"), F.lit(1))
    return c.select("sensor_count", "flagged_count", F.round(ratio, 4).alias("flagged_ratio"), F.when(ratio <= 0.1, "LOW").when(ratio <= 0.25, "MEDIUM").otherwise("HIGH").alias("flag_level"))


@query("technical_summary", f"WITH {_SUMMARY} SELECT survey_level, fit_level, residual_level, overall_level, round(high_ratio, 9) AS high_ratio, round(normalized_rmse, 9) AS normalized_rmse FROM t")
def technical_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("survey_level", "fit_level", "residual_level", "overall_level", F.round("high_ratio", 9).alias("high_ratio"), F.round("normalized_rmse", 9).alias("normalized_rmse"))


@query("qaqc_summary", f"WITH {_QAQC} SELECT n, round(coverage_x, 9) AS coverage_x, round(coverage_z, 9) AS coverage_z, round(dynamic_range, 6) AS dynamic_range, round(std, 6) AS std, round(rms, 6) AS rms, array_to_string(warnings, ',') AS warnings, survey_level AS level, CASE survey_level WHEN 'GOOD' THEN CAST(1 AS DOUBLE) WHEN 'MEDIUM' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS score FROM s")
def qaqc_summary(spark, sf_dir):
    q = D.qaqc(A.observations(spark, sf_dir), 6000.0, 25000.0)
    return q.select("n", F.round("coverage_x", 9).alias("coverage_x"), F.round("coverage_z", 9).alias("coverage_z"), *[F.round(c, 6).alias(c) for c in ("dynamic_range", "std", "rms")], F.array_join("warnings", ",").alias("warnings"), F.col("survey_level").alias("level"), F.col("survey_score").alias("score"))


_BY = lambda c, medium, low: f"CASE {c} WHEN 'MEDIUM' THEN CAST({medium} AS DOUBLE) WHEN 'LOW' THEN CAST({low} AS DOUBLE) ELSE 0 END"


@query("uncertainty_rubric", f"""
WITH {_SUMMARY}, u AS (SELECT least(round({_BY("survey_level", 0.15, 0.3)} + CASE WHEN coverage_x < CAST(0.6 AS DOUBLE) AND coverage_z < CAST(0.6 AS DOUBLE) THEN CAST(0.2 AS DOUBLE) WHEN coverage_x < CAST(0.6 AS DOUBLE) OR coverage_z < CAST(0.6 AS DOUBLE) THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN dynamic_range <= CAST(1e-6 AS DOUBLE) THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN std <= CAST(1e-9 AS DOUBLE) THEN CAST(0.15 AS DOUBLE) ELSE 0 END
+ {_BY("fit_level", 0.2, 0.4)} + CASE WHEN high_ratio > CAST(0.25 AS DOUBLE) THEN CAST(0.3 AS DOUBLE) WHEN high_ratio > CAST(0.1 AS DOUBLE) THEN CAST(0.15 AS DOUBLE) ELSE 0 END + {_BY("overall_level", 0.1, 0.25)}, 3), 1) AS uncertainty_score FROM t)
SELECT uncertainty_score, CASE WHEN uncertainty_score < CAST(0.35 AS DOUBLE) THEN 'LOW' WHEN uncertainty_score < CAST(0.7 AS DOUBLE) THEN 'MEDIUM' ELSE 'HIGH' END AS uncertainty_level FROM u""")
def uncertainty_rubric(spark, sf_dir):
    return D.uncertainty(_summary(spark, sf_dir)).select("uncertainty_score", "uncertainty_level")


@query("report_aggregates", """
SELECT min(density) AS lo, round(avg(density), 6) AS mean, max(density) AS hi, round(sum(density * grade) / sum(density), 6) AS weighted_grade, round(sum(density * 15625), 2) AS mass_t FROM v_voxels""")
def report_aggregates(spark, sf_dir):
    return A.voxels(spark, sf_dir).agg(F.min("density").alias("lo"), F.round(F.avg("density"), 6).alias("mean"), F.max("density").alias("hi"), F.round(F.sum(F.col("density") * F.col("grade")) / F.sum("density"), 6).alias("weighted_grade"), F.round(F.sum(F.col("density") * 15625), 2).alias("mass_t"))


@query("best_target", "SELECT arg_max(voxel_id, (probability * greatest(density - CAST(2.6 AS DOUBLE), 0) * greatest(grade, CAST(0.01 AS DOUBLE)), -voxel_id)) AS voxel_id FROM v_voxels")
def best_target(spark, sf_dir):
    score = F.col("probability") * F.greatest(F.col("density") - 2.6, F.lit(0.0)) * F.greatest(F.col("grade"), F.lit(0.01))
    return A.voxels(spark, sf_dir).agg(F.max_by("voxel_id", F.struct(score, -F.col("voxel_id"))).alias("voxel_id"))


@query("doi_summary", "SELECT count(*) AS n, round(median(grade), 9) AS p50, round(quantile_cont(grade, CAST(0.85 AS DOUBLE)), 9) AS p85, round(quantile_cont(grade, CAST(0.95 AS DOUBLE)), 9) AS p95, max(grade) AS max, round(avg(CASE WHEN grade <= (SELECT median(grade) FROM v_voxels) THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS below_median FROM v_voxels")
def doi_summary(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    return v.join(F.broadcast(v.agg(F.percentile("grade", 0.5).alias("m")))).agg(F.count("*").alias("n"), *[F.round(F.percentile("grade", q), 9).alias(f"p{int(q * 100)}") for q in (0.5, 0.85, 0.95)], F.max("grade").alias("max"), F.round(F.avg((F.col("grade") <= F.col("m")).cast("double")), 9).alias("below_median"))


@query("saturation_cube", "SELECT core, bound, count(*) AS n FROM (SELECT CASE WHEN ix BETWEEN 3 AND 16 THEN 'core' ELSE 'padding' END AS core, CASE WHEN density <= CAST(2.61 AS DOUBLE) THEN 'low' WHEN density >= CAST(4.19 AS DOUBLE) THEN 'high' ELSE 'inside' END AS bound FROM v_voxels) GROUP BY CUBE (core, bound)")
def saturation_cube(spark, sf_dir):
    v = A.voxels(spark, sf_dir).select(F.when(F.col("ix").between(3, 16), "core").otherwise("padding").alias("core"), F.when(F.col("density") <= 2.61, "low").when(F.col("density") >= 4.19, "high").otherwise("inside").alias("bound"))
    return v.cube("core", "bound").agg(F.count("*").alias("n"))


@query("priority_class", """
SELECT voxel_id, CASE WHEN probability >= CAST(0.75 AS DOUBLE) AND density >= CAST(3.4 AS DOUBLE) THEN 'HIGH' WHEN probability >= CAST(0.5 AS DOUBLE) THEN 'MEDIUM' WHEN probability >= CAST(0.25 AS DOUBLE) THEN 'LOW' ELSE 'NOT_RANKED' END AS class FROM v_voxels""")
def priority_class(spark, sf_dir):
    p = F.col("probability")
    return A.voxels(spark, sf_dir).select("voxel_id", F.when((p >= 0.75) & (F.col("density") >= 3.4), "HIGH").when(p >= 0.5, "MEDIUM").when(p >= 0.25, "LOW").otherwise("NOT_RANKED").alias("class"))


@query("fav_intensity", """
WITH m AS (SELECT median(density) AS m, quantile_cont(density, CAST(0.95 AS DOUBLE)) AS p FROM v_voxels), d AS (SELECT median(abs(density - m)) AS mad, any_value(m) AS m, any_value(p) AS p FROM v_voxels, m), z AS (SELECT (p - m) / (CAST(1.4826 AS DOUBLE) * mad + CAST(1e-9 AS DOUBLE)) AS z FROM d) SELECT round(z, 6) AS robust_z, round(least(greatest(z / 3, 0), 1), 6) AS score FROM z""")
def fav_intensity(spark, sf_dir):
    return D.robust_intensity(A.voxels(spark, sf_dir), "density").select(F.round("robust_z", 6).alias("robust_z"), F.round("score", 6).alias("score"))


@query("fav_depth", """
WITH d AS (SELECT avg(y) AS depth FROM v_voxels WHERE density >= (SELECT quantile_cont(density, CAST(0.9 AS DOUBLE)) FROM v_voxels))
SELECT round(depth, 6) AS depth_m, CASE WHEN depth <= 50 THEN CAST(0.65 AS DOUBLE) WHEN depth <= 500 THEN CAST(1 AS DOUBLE) WHEN depth <= 1200 THEN CAST(0.85 AS DOUBLE) WHEN depth <= 2500 THEN CAST(0.55 AS DOUBLE) WHEN depth <= 4000 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS score FROM d""")
def fav_depth(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    d = v.join(F.broadcast(v.agg(F.percentile("density", 0.9).alias("cut")))).where("density >= cut").agg(F.avg("y").alias("d"))
    return d.select(F.round("d", 6).alias("depth_m"), D.depth_score(F.col("d")).alias("score"))


_COMP = """cut AS (SELECT quantile_cont(density, CAST(0.9 AS DOUBLE)) AS cut FROM v_voxels), m AS (SELECT voxel_id, ix, iy, iz FROM v_voxels, cut WHERE density >= cut),
e AS (SELECT a.voxel_id AS i, b.voxel_id AS j FROM m a JOIN m b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1),
w AS (SELECT voxel_id AS i, voxel_id AS label FROM m UNION SELECT e.j, w.label FROM w JOIN e ON e.i = w.i), c AS (SELECT i AS voxel_id, min(label) AS label FROM w GROUP BY i)"""


def _bodies(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    mask = v.join(F.broadcast(v.agg(F.percentile("density", 0.9).alias("cut")))).where("density >= cut").drop("cut")
    return v, mask, G.labelled(mask.select("voxel_id"), S.face_edges(mask))


@query("bodies", f"WITH RECURSIVE {_COMP} SELECT label, count(*) AS cells, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, max(density) AS densest FROM c JOIN v_voxels USING (voxel_id) GROUP BY label")
def bodies(spark, sf_dir):
    v, _, c = _bodies(spark, sf_dir)
    return c.join(v, "voxel_id").groupBy("label").agg(F.count("*").alias("cells"), *[F.round(F.avg(a), 6).alias(a) for a in "xyz"], F.max("density").alias("densest"))


@query("bodies_26", f"WITH RECURSIVE {_COMP.replace('abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1', 'greatest(abs(a.ix - b.ix), abs(a.iy - b.iy), abs(a.iz - b.iz)) = 1')} SELECT label, count(*) AS cells, count(*) * 15625 AS volume_m3 FROM c GROUP BY label")
def bodies_26(spark, sf_dir):
    """Bodies whose cells may touch at an edge or a corner only."""
    v = A.voxels(spark, sf_dir)
    mask = v.join(F.broadcast(v.agg(F.percentile("density", 0.9).alias("cut")))).where("density >= cut").drop("cut")
    c = G.labelled(mask.select("voxel_id"), S.touching_edges(mask))
    return c.groupBy("label").agg(F.count("*").alias("cells"), (F.count("*") * 15625).alias("volume_m3"))


@query("fav_coherence", f"WITH RECURSIVE {_COMP}, s AS (SELECT count(*) AS n FROM c GROUP BY label) SELECT round(CAST(max(n) AS DOUBLE) / sum(n), 9) AS score FROM s")
def fav_coherence(spark, sf_dir):
    s = _bodies(spark, sf_dir)[2].groupBy("label").agg(F.count("*").alias("n"))
    return s.agg(F.round(F.max("n").cast("double") / F.sum("n"), 9).alias("score"))


_D = lambda w: f"CASE WHEN lag(density) OVER {w} IS NULL THEN (lead(density) OVER {w} - density) / 25 WHEN lead(density) OVER {w} IS NULL THEN (density - lag(density) OVER {w}) / 25 ELSE (lead(density) OVER {w} - lag(density) OVER {w}) / 50 END"


@query("fav_gradient", f"""
WITH g AS (SELECT density, {_D('wx')} AS gx, {_D('wy')} AS gy, {_D('wz')} AS gz FROM v_voxels WINDOW wx AS (PARTITION BY iy, iz ORDER BY ix), wy AS (PARTITION BY ix, iz ORDER BY iy), wz AS (PARTITION BY ix, iy ORDER BY iz))
SELECT round(coalesce(least(greatest(quantile_cont(sqrt(gx * gx + gy * gy + gz * gz), CAST(0.9 AS DOUBLE)) / ((max(density) - min(density)) / 25 + CAST(1e-9 AS DOUBLE)), 0), 1), 0), 6) AS score FROM g""")
def fav_gradient(spark, sf_dir):
    g = S.gradient(A.voxels(spark, sf_dir), "density", 25.0)
    size = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    score = F.percentile(size, 0.9) / ((F.max("density") - F.min("density")) / 25 + 1e-9)
    return g.agg(F.round(F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 6).alias("score"))


@query("fav_jaccard", """
WITH q AS (SELECT quantile_cont(density, CAST(0.9 AS DOUBLE)) AS a, quantile_cont(grade, CAST(0.9 AS DOUBLE)) FILTER (grade > 0) AS b FROM v_voxels)
SELECT round(CAST(count(*) FILTER (density >= a AND grade >= b) AS DOUBLE) / greatest(count(*) FILTER (density >= a OR grade >= b), 1), 9) AS score FROM v_voxels, q""")
def fav_jaccard(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    q = v.agg(F.percentile("density", 0.9).alias("a"), F.percentile(F.when(F.col("grade") > 0, F.col("grade")), 0.9).alias("b"))
    x, y = F.col("density") >= F.col("a"), F.col("grade") >= F.col("b")
    return v.join(F.broadcast(q)).agg(F.round(F.count(F.when(x & y, 1)).cast("double") / F.greatest(F.count(F.when(x | y, 1)), F.lit(1)), 9).alias("score"))


_SCORES = {"anomaly_intensity": "fav_intensity", "depth_accessibility": "fav_depth", "core_coherence": "fav_coherence", "structural_gradient": "fav_gradient", "msx_support": "fav_jaccard"}


def _factor_sql():
    """The six factors' own SQL, a row each."""
    from lodestone.plans import contract  # noqa: F401  (registers fav_satellite)

    rows = [f"SELECT CAST({D.WEIGHTS[f]} AS DOUBLE) AS weight, (SELECT score FROM ({SQL[q]})) AS value" for f, q in _SCORES.items()]
    return " UNION ALL ".join([*rows, f"SELECT CAST({D.WEIGHTS['satellite_support']} AS DOUBLE), (SELECT avg(value) FROM ({SQL['fav_satellite']}) WHERE status = 'evaluated')"])


@query("fav_aggregate", f"""
WITH f AS (SELECT weight, least(greatest(value, 0), 1) AS value FROM ({_factor_sql()}))
SELECT round(sum(value * weight) / sum(weight), 6) AS evidence, round(sum(weight), 6) AS weight, round(100 * sum(value * weight) / sum(weight) * CAST(0.6 AS DOUBLE) * (1 - CAST(0.4 AS DOUBLE) * CAST(0.5 AS DOUBLE)), 6) AS raw, round(least(100 * sum(value * weight) / sum(weight) * CAST(0.6 AS DOUBLE) * (1 - CAST(0.4 AS DOUBLE) * CAST(0.5 AS DOUBLE)), 60), 6) AS score FROM f WHERE value IS NOT NULL""")
def fav_aggregate(spark, sf_dir):
    """The six factors' own results together; favorability_of_runs does it for many runs, with their gates."""
    rows = [QUERIES[q](spark, sf_dir).select(F.lit(D.WEIGHTS[f]).alias("weight"), F.col("score").cast("double").alias("value")) for f, q in _SCORES.items()]
    rows.append(QUERIES["fav_satellite"](spark, sf_dir).where("status = 'evaluated'").agg(F.avg("value").alias("value")).select(F.lit(D.WEIGHTS["satellite_support"]).alias("weight"), "value"))
    f = reduce(DataFrame.unionByName, rows).select("weight", F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0)).alias("value")).where("value IS NOT NULL")
    out = D.aggregate_score(f, F.lit(0.6) * (1 - F.lit(0.4) * 0.5), F.lit(60.0))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("report_signal", """
WITH a AS (SELECT avg(probability * least(greatest((density - CAST(2.6 AS DOUBLE)) / CAST(1.6 AS DOUBLE), 0), 1)) AS s, max(probability) AS p, max(density) AS d, sum(grade * greatest(density * 15625, CAST(1e-9 AS DOUBLE))) / sum(greatest(density * 15625, CAST(1e-9 AS DOUBLE))) AS g FROM v_voxels)
SELECT round(s, 6) AS anomaly_score, p AS max_probability, round(g, 6) AS avg_grade, CASE WHEN d >= CAST(2.75 AS DOUBLE) AND p >= CAST(0.45 AS DOUBLE) AND g >= CAST(0.3 AS DOUBLE) THEN 'DRILL_CANDIDATE' ELSE 'OBSERVE' END AS preliminary_signal, CASE WHEN p < CAST(0.45 AS DOUBLE) OR d < CAST(2.75 AS DOUBLE) THEN 'HIGH' WHEN p < CAST(0.75 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM a""")
def report_signal(spark, sf_dir):
    """One row: anomaly score, weighted grade, signal and risk level of the model."""
    v = A.voxels(spark, sf_dir).select("density", "probability", "grade", (F.col("density") * 15625).alias("mass"))
    out = D.report_signal(v, 2.75)
    return out.select(F.round("anomaly_score", 6).alias("anomaly_score"), "max_probability", F.round("avg_grade", 6).alias("avg_grade"), "preliminary_signal", "risk_level")


@query("run_compare", """
WITH a AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT metric, round(a.v, 4) AS a, round(b.v, 4) AS b, round(b.v - a.v, 4) AS delta FROM a FULL JOIN b USING (metric)""")
def run_compare(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    run = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias(n))
    return run("F", "a").join(run("O", "b"), "metric", "full").select("metric", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round(F.col("b") - F.col("a"), 4).alias("delta"))


@query("runs_per_project", "SELECT o_custkey AS project, count(*) AS runs, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def runs_per_project(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("runs"), F.max("o_orderkey").alias("latest"))


@query("run_artefacts", "SELECT o_orderkey AS run, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ','), '') AS artefacts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def run_artefacts(spark, sf_dir):
    o, li = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy(F.col("o_orderkey").alias("run")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("artefacts"))


@query("event_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
