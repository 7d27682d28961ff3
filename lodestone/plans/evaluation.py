"""Queries that hold scores against labels, and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import blockmodel as B
from lodestone.operators import evaluation as E
from lodestone.operators import profile as P
from lodestone.plans.registry import query
from lodestone.sources import adapters as A

_L = "l AS (SELECT voxel_id, probability AS s, density >= CAST(3.4 AS DOUBLE) AS y FROM v_voxels)"
_C = _L + """, g AS (SELECT s, sum(CAST(y AS INTEGER)) AS dp, sum(1 - CAST(y AS INTEGER)) AS dn FROM l GROUP BY s),
c AS (SELECT s, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER () AS p, sum(dn) OVER () AS n FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


def _labelled(spark, sf_dir):
    return A.voxels(spark, sf_dir).select("voxel_id", F.col("probability").alias("s"), (F.col("density") >= 3.4).alias("y"))


@query("roc_auc", f"WITH {_C}, d AS (SELECT fp - coalesce(lag(fp) OVER (ORDER BY s DESC), 0) AS w, tp + coalesce(lag(tp) OVER (ORDER BY s DESC), 0) AS h, p, n FROM c) SELECT round(CAST(sum(w * h) AS DOUBLE) / 2 / max(p * n), 9) AS auc FROM d")
def roc_auc(spark, sf_dir):
    return E.roc_auc(_labelled(spark, sf_dir), "s", F.col("y")).select(F.round("auc", 9).alias("auc"))


@query("pr_auc", f"WITH {_C}, q AS (SELECT s, CAST(tp AS DOUBLE) / p AS r, CAST(tp AS DOUBLE) / (tp + fp) AS pr FROM c), d AS (SELECT r - coalesce(lag(r) OVER (ORDER BY s DESC), 0) AS w, pr + coalesce(lag(pr) OVER (ORDER BY s DESC), 1) AS h, r - coalesce(lag(r) OVER (ORDER BY s DESC), r) AS w2, pr + coalesce(lag(pr) OVER (ORDER BY s DESC), pr) AS h2 FROM q) SELECT round(sum(w * h / 2), 9) AS anchored, round(sum(w2 * h2 / 2), 9) AS plain FROM d")
def pr_auc(spark, sf_dir):
    one = lambda flag, name: E.pr_auc(_labelled(spark, sf_dir), "s", F.col("y"), flag).select(F.round("auc", 9).alias(name))
    return one(True, "anchored").join(one(False, "plain"))


@query("threshold_sweep", f"""
WITH {_L}, e AS (SELECT min(s) AS lo, max(s) AS hi FROM l), k AS (SELECT least(CAST(floor((s - lo) / greatest(hi - lo, CAST(1e-12 AS DOUBLE)) * 199 + CAST(1e-9 AS DOUBLE)) AS BIGINT), 199) AS k, y FROM l, e),
t AS (SELECT range AS k FROM range(0, 200)), c AS (SELECT t.k, CAST(count(*) FILTER (y) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT y) AS DOUBLE) AS fp FROM t LEFT JOIN k ON k.k >= t.k GROUP BY t.k), p AS (SELECT count(*) AS p FROM l WHERE y)
SELECT CAST(k AS INTEGER) AS k, round(2 * tp / (tp + fp + p), 9) AS f1, round(tp / (fp + p), 9) AS iou FROM c, p""")
def threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(_labelled(spark, sf_dir), "s", F.col("y")).select("k", F.round("f1", 9).alias("f1"), F.round("iou", 9).alias("iou"))


@query("otsu", """
WITH v AS (SELECT grade AS x FROM v_voxels WHERE grade > 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v), h AS (SELECT least(CAST(floor((x - lo) / greatest((hi - lo) / 256, CAST(1e-300 AS DOUBLE))) AS BIGINT), 255) AS b, count(*) AS n FROM v, e GROUP BY 1),
c AS (SELECT b, lo + (b + CAST(0.5 AS DOUBLE)) * (hi - lo) / 256 AS centre, n FROM h, e), w AS (SELECT b, centre, sum(n) OVER o AS n0, sum(n * centre) OVER o AS s0, sum(n) OVER () AS nt, sum(n * centre) OVER () AS st FROM c WINDOW o AS (ORDER BY b ROWS UNBOUNDED PRECEDING)),
r AS (SELECT b, centre, round(CAST(n0 AS DOUBLE) * (nt - n0) * pow(s0 / n0 - (st - s0) / (nt - n0), 2), 6) AS v FROM w WHERE nt > n0) SELECT round(arg_max(centre, (v, -b)), 6) AS threshold FROM r""")
def otsu(spark, sf_dir):
    return E.otsu(A.voxels(spark, sf_dir), "grade").select(F.round("threshold", 6).alias("threshold"))


@query("topk_overlap", """
WITH a AS (SELECT voxel_id FROM v_voxels ORDER BY density DESC, voxel_id LIMIT 100), b AS (SELECT voxel_id FROM v_voxels ORDER BY grade DESC, voxel_id LIMIT 100) SELECT CAST(count(*) AS DOUBLE) / 100 AS overlap FROM a JOIN b USING (voxel_id)""")
def topk_overlap(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    a, b = (B.top(v, c, 100, "voxel_id").select("voxel_id") for c in ("density", "grade"))
    return a.join(b, "voxel_id").agg((F.count("*") / 100.0).alias("overlap"))


@query("pearson_recovery", """
WITH r AS (SELECT density - CAST(2.6 AS DOUBLE) AS t, (density - CAST(2.6 AS DOUBLE)) * (CAST(0.5 AS DOUBLE) + probability) - CAST(0.2 AS DOUBLE) AS m FROM v_voxels)
SELECT round(corr(t, m), 6) AS pearson, round(avg(CASE WHEN sign(t) = sign(m) THEN CAST(100 AS DOUBLE) ELSE 0 END), 6) AS sign_percent, round(sqrt(avg(pow(t - m, 2))), 6) AS rmse, round(sqrt(avg(pow(t - m, 2))) / (max(t) - min(t)), 6) AS nrmse, round(10 * log10(avg(t * t) / avg(pow(t - m, 2))), 6) AS snr_db, CASE WHEN corr(t, m) >= CAST(0.6 AS DOUBLE) THEN 'PASS' WHEN corr(t, m) >= CAST(0.4 AS DOUBLE) THEN 'WARN' ELSE 'FAIL' END AS label FROM r""")
def pearson_recovery(spark, sf_dir):
    t = F.col("density") - 2.6
    r = A.voxels(spark, sf_dir).select(t.alias("t"), (t * (0.5 + F.col("probability")) - 0.2).alias("m"))
    mse, c = F.avg(F.pow(F.col("t") - F.col("m"), 2)), F.corr("t", "m")
    return r.agg(F.round(c, 6).alias("pearson"), F.round(F.avg(F.when(F.signum("t") == F.signum("m"), 100.0).otherwise(0.0)), 6).alias("sign_percent"), F.round(F.sqrt(mse), 6).alias("rmse"), F.round(F.sqrt(mse) / (F.max("t") - F.min("t")), 6).alias("nrmse"), F.round(10 * F.log10(F.avg(F.col("t") * F.col("t")) / mse), 6).alias("snr_db"), F.when(c >= 0.6, "PASS").when(c >= 0.4, "WARN").otherwise("FAIL").alias("label"))


@query("weighted_centroid", "WITH w AS (SELECT greatest(density - 3, 0) AS w, x, y, z FROM v_voxels) SELECT round(sum(w * x) / nullif(sum(w), 0), 6) AS x, round(sum(w * y) / nullif(sum(w), 0), 6) AS y, round(sum(w * z) / nullif(sum(w), 0), 6) AS z FROM w")
def weighted_centroid(spark, sf_dir):
    return E.weighted_centroid(A.voxels(spark, sf_dir), F.col("density") - 3, ["x", "y", "z"]).select(*[F.round(c, 6).alias(c) for c in "xyz"])


@query("mask_metrics", """
WITH m AS (SELECT count(*) FILTER (density >= CAST(3.4 AS DOUBLE) AND grade >= 1) AS tp, count(*) FILTER (density < CAST(3.4 AS DOUBLE) AND grade >= 1) AS fp, count(*) FILTER (density >= CAST(3.4 AS DOUBLE) AND grade < 1) AS fn FROM v_voxels)
SELECT tp, fp, fn, round(CAST(tp AS DOUBLE) / (tp + fp + fn), 9) AS iou, round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 9) AS recall, round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 9) AS f1 FROM m""")
def mask_metrics(spark, sf_dir):
    m = E.mask_metrics(A.voxels(spark, sf_dir), F.col("density") >= 3.4, F.col("grade") >= 1)
    return m.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("iou", "precision", "recall", "f1")])


@query("ensemble_vote", """
WITH m AS (SELECT voxel_id, k.range AS member, density + CAST((voxel_id * 7 + k.range * 13) % 11 AS DOUBLE) / 20 - CAST(3 AS DOUBLE) AS c FROM v_voxels, range(0, 5) k)
SELECT voxel_id, round(median(c), 9) AS median, round(stddev_pop(c), 9) AS std, avg(CASE WHEN c >= CAST(0.5 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS vote, CASE WHEN avg(CASE WHEN c >= CAST(0.5 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END) >= CAST(0.8 AS DOUBLE) THEN 'core' WHEN avg(CASE WHEN c >= CAST(0.5 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END) >= CAST(0.2 AS DOUBLE) THEN 'shell' ELSE 'background' END AS class FROM m GROUP BY voxel_id""")
def ensemble_vote(spark, sf_dir):
    v = A.voxels(spark, sf_dir).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(4))))
    m = v.withColumn("c", F.col("density") + ((F.col("voxel_id") * 7 + F.col("member") * 13) % 11).cast("double") / 20 - 3.0)
    vote = F.avg(F.when(F.col("c") >= 0.5, 1.0).otherwise(0.0))
    out = m.groupBy("voxel_id").agg(F.round(F.percentile("c", 0.5), 9).alias("median"), F.round(F.stddev_pop("c"), 9).alias("std"), vote.alias("vote"))
    return out.withColumn("class", F.when(F.col("vote") >= 0.8, "core").when(F.col("vote") >= 0.2, "shell").otherwise("background"))


@query("rebound", """
WITH m AS (SELECT iz AS run, voxel_id AS it, density AS misfit, min(density) OVER (PARTITION BY iz ORDER BY voxel_id ROWS UNBOUNDED PRECEDING) AS best FROM v_voxels) SELECT run, it, misfit, misfit > best * CAST(1.05 AS DOUBLE) AS rebound FROM m""")
def rebound(spark, sf_dir):
    """Iterations of every run, 200 rows each: worse than the best so far by more than 5 %."""
    from pyspark.sql import Window

    w = Window.partitionBy("iz").orderBy("voxel_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = A.voxels(spark, sf_dir).withColumn("best", F.min("density").over(w))
    return m.select(F.col("iz").alias("run"), F.col("voxel_id").alias("it"), F.col("density").alias("misfit"), (F.col("density") > F.col("best") * 1.05).alias("rebound"))


@query("lcurve_corner", """
WITH h AS (SELECT iy AS i, sum(density) AS d, sum(grade) AS g FROM v_voxels GROUP BY iy), c AS (SELECT i, sum(d) OVER (ORDER BY i) AS misfit, sum(g) OVER (ORDER BY i DESC) AS norm FROM h), l AS (SELECT *, log10(misfit) AS a, log10(norm) AS b FROM c), e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM l),
n AS (SELECT i, misfit, norm, (a - a0) / (a1 - a0) AS u, (b - b0) / (b1 - b0) AS v FROM l, e), t AS (SELECT *, lag(u) OVER o AS ua, lag(v) OVER o AS va, lead(u) OVER o AS ub, lead(v) OVER o AS vb FROM n WINDOW o AS (ORDER BY i)),
d AS (SELECT *, sqrt(pow(u - ua, 2) + pow(v - va, 2)) AS d1, sqrt(pow(u - ub, 2) + pow(v - vb, 2)) AS d2, sqrt(pow(ub - ua, 2) + pow(vb - va, 2)) AS d3 FROM t), k AS (SELECT i, misfit, norm, 2 * abs((u - ua) * (vb - va) - (v - va) * (ub - ua)) / (d1 * d2 * d3) AS curvature FROM d WHERE least(d1, d2, d3) >= CAST(0.001 AS DOUBLE))
SELECT i, round(misfit, 6) AS misfit, round(norm, 6) AS norm, round(curvature, 4) AS curvature FROM k ORDER BY k.curvature DESC, i LIMIT 1""")
def lcurve_corner(spark, sf_dir):
    """The corner of the curve of mass above against grade below each level of depth."""
    from pyspark.sql import Window

    h = A.voxels(spark, sf_dir).groupBy(F.col("iy").alias("i")).agg(F.sum("density").alias("d"), F.sum("grade").alias("g"))  # a row for each level
    curve = h.select("i", F.sum("d").over(Window.orderBy("i")).alias("misfit"), F.sum("g").over(Window.orderBy(F.desc("i"))).alias("norm"))
    return E.lcurve_corner(curve, "i", "misfit", "norm").select("i", F.round("misfit", 6).alias("misfit"), F.round("norm", 6).alias("norm"), F.round("curvature", 4).alias("curvature"))


@query("sweep_best", "SELECT voxel_id, density AS nrmse, grade AS quality, probability AS lambda FROM v_voxels ORDER BY density, grade DESC, probability, voxel_id LIMIT 12")
def sweep_best(spark, sf_dir):
    return A.voxels(spark, sf_dir).orderBy("density", F.desc("grade"), "probability", "voxel_id").limit(12).select("voxel_id", F.col("density").alias("nrmse"), F.col("grade").alias("quality"), F.col("probability").alias("lambda"))


@query("sweep_cases", "SELECT CAST(row_number() OVER (ORDER BY l, a) AS INTEGER) AS case_id, l AS lambda, a AS alpha FROM (SELECT DISTINCT CAST(3 AS DOUBLE) * (r_regionkey + 1) / 10 AS l FROM region), (SELECT DISTINCT CAST(n_nationkey % 5 * 5 + 1 AS DOUBLE) AS a FROM nation) QUALIFY row_number() OVER (ORDER BY l, a) <= 12")
def sweep_cases(spark, sf_dir):
    """A grid of parameters of the regions and nations, twelve cases at most."""
    la = A.table(spark, sf_dir, "region").select((F.lit(3.0) * (F.col("r_regionkey") + 1) / 10).alias("lambda")).distinct()
    al = A.table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5 * 5 + 1).cast("double").alias("alpha")).distinct()
    grid = la.join(F.broadcast(al.agg(F.collect_set("alpha").alias("alphas")))).select("lambda", F.explode("alphas").alias("alpha"))  # few of each
    first = grid.orderBy("lambda", "alpha").limit(12)
    return first.select(P.rank_over([F.col("lambda"), F.col("alpha")]).cast("int").alias("case_id"), "lambda", "alpha")
